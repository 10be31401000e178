"""Quality rules as a short-circuit cascade, in DataFrame functions alone.

Each rule has a condition on one or two counts of the text.  A sample gives each
rule's cost and the share of documents it rejects; rules then stand in the order
of rejection per cost, in one CASE whose later branches are not evaluated for a
document that an earlier one rejects: counts that only such a rule needs are
never taken.  The order never changes a verdict.

A rule's cost is the time that its condition adds to splitting the sample's texts
into words and lines, the least of a few runs over the sample.

Words are runs of characters other than the six ASCII white-space ones.

Defined results: a null text has no words and fails the base rules, as does an
empty one; repeated rows give repeated results; other columns play no part; an
empty table gives no rows (and keeps the rules' given order).
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import partial, reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.session import released, stored

#: Documents on which costs and selectivity are estimated, at most.
SAMPLE_ROWS = 200
#: Times that a rule is run over the sample.
SAMPLE_RUNS = 2

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
#: Lines that begin as list items, and lines that break off.
BULLET = r"^[\x20\x09]*([*\x2D\x{2022}\x{25CF}]|[0-9]+[.)])[\x20\x09]"
CUT = r"(\.\.\.|\x{2026})[\x20\x09-\x0D]*$"


class Counts:
    """The counts of a text by name: columns that are made when a rule asks for them."""

    def __init__(self, makers: dict[str, Callable[[], Column]], known: dict[str, Column]):
        self.makers, self.known = makers, known

    def __getitem__(self, name: str) -> Column:
        return self.known[name] if name in self.known else self.makers[name]()

    def with_known(self, known: dict[str, Column]) -> Counts:
        return Counts(self.makers, self.known | known)


@dataclass(frozen=True)
class Rule:
    """Rejects a document if `fails` holds of its counts."""

    name: str
    fails: Callable[[Counts], Column]
    sql: str


BASE = (
    Rule("few_words", lambda c: c["n_words"] < 50, "n_words < 50"),
    Rule("repeated_words", lambda c: 100 * c["n_repeat_words"] > 50 * c["n_words"], "100 * n_repeat_words > 50 * n_words"),
)
RULES = (
    Rule("word_length", lambda c: ~c["word_chars"].between(2 * c["n_words"], 15 * c["n_words"]), "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    Rule("symbols", lambda c: 10 * c["n_symbols"] > 3 * c["n_words"], "10 * n_symbols > 3 * n_words"),
    Rule("repeated_lines", lambda c: 2 * c["n_dup_lines"] > c["n_lines"], "2 * n_dup_lines > n_lines"),
    Rule("no_letters", lambda c: 10 * c["n_letter_words"] < 6 * c["n_words"], "10 * n_letter_words < 6 * n_words"),
    Rule("bullets", lambda c: 10 * c["n_bullet_lines"] > 9 * c["n_lines"], "10 * n_bullet_lines > 9 * n_lines"),
    Rule("cut_lines", lambda c: 10 * c["n_cut_lines"] > 3 * c["n_lines"], "10 * n_cut_lines > 3 * n_lines"),
    Rule("one_word", lambda c: 5 * c["n_top_word"] > 2 * c["n_words"], "5 * n_top_word > 2 * n_words"),
)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, wherever the optimizer moves the expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def lines_of(text: Column) -> Column:
    """The lines that have a word."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def repeated_words(words: Column, width: int = 3) -> Column:
    """How many words lie in a window of `width` words that occurs twice or more.

    Each window is one number, sorted as such: 40 bits of its words' hash above
    24 bits of its place.  Windows that share the 40 bits with a neighbour are
    compared by their words; if any two such differ, which takes a hash clash,
    the text's windows are sorted by their words instead, so that the hash
    decides nothing.  A covered word is counted once: a window adds as many
    words as lie before the next one's start.
    """
    n = F.size(words)
    starts = F.sequence(F.lit(0), n - width)
    top = lambda x: F.shiftright(x, 24)
    place = lambda x: x.bitwiseAND(F.lit((1 << 24) - 1)).cast("int")
    window = lambda i: F.slice(words, i + 1, F.lit(width))
    keys = F.sort_array(F.transform(starts, lambda i: F.shiftleft(F.xxhash64(*(F.get(words, i + k) for k in range(width))), 24).bitwiseOR(i.cast("bigint"))))

    def twice(rows: Column, same: Callable[[Column, Column], Column]) -> Column:
        """The rows that are the same as a neighbour."""
        near = lambda i, j: F.coalesce(same(F.get(rows, i), F.get(rows, j)), F.lit(False))
        return F.transform(F.filter(F.sequence(F.lit(0), F.size(rows) - 1), lambda i: near(i, i - 1) | near(i, i + 1)), lambda i: F.get(rows, i))

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(0).alias("sum"), F.lit(-width).alias("last"))
        return F.aggregate(F.sort_array(at), start, lambda s, x: F.struct((s["sum"] + F.least(F.lit(width), x - s["last"])).alias("sum"), x.alias("last")), lambda s: s["sum"])

    def exact() -> Column:
        """The places of repeated windows, by the words themselves."""
        by_words = F.array_sort(F.transform(starts, lambda i: F.struct(window(i).alias("words"), i.alias("at"))))
        return F.transform(bind(by_words, lambda r: twice(r, lambda a, b: a["words"] == b["words"])), lambda x: x["at"])

    def checked(rows: Column) -> Column:
        """`rows` share 40 bits with a neighbour: counts them, or all windows by their words after a clash."""
        clash = F.exists(F.sequence(F.lit(1), F.size(rows) - 1), lambda i: (top(F.get(rows, i)) == top(F.get(rows, i - 1))) & (window(place(F.get(rows, i))) != window(place(F.get(rows, i - 1)))))
        return F.when(F.size(rows) < 2, F.lit(0)).otherwise(covered(F.when(clash, exact()).otherwise(F.transform(rows, place))))

    found = bind(bind(keys, lambda k: twice(k, lambda a, b: top(a) == top(b))), checked)
    return F.when(n <= width, F.lit(0)).when(n > 1 << 24, covered(exact())).otherwise(found).cast("bigint")


def most_frequent(words: Column) -> Column:
    """How often the most frequent word occurs, by the runs of the sorted words."""
    state = F.struct(F.lit(None).cast("bigint").alias("word"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(s: Column, word: Column) -> Column:
        return bind(F.when(s["word"] == word, s["run"] + 1).otherwise(F.lit(1)), lambda run: F.struct(word.alias("word"), run.alias("run"), F.greatest(s["most"], run).alias("most")))

    # numbers sort faster than words; two words of one hash only add up
    return F.aggregate(F.sort_array(F.transform(words, lambda w: F.xxhash64(w))), state, step, lambda s: s["most"])


def measured(use: Callable[[Counts], Column]) -> Column:
    """An expression over the counts of the column `text`, which is split into words and lines once."""
    return bind(F.coalesce(F.col("text"), F.lit("")), lambda t: bind(F.struct(t.alias("text"), words_of(t).alias("words"), lines_of(t).alias("lines")), lambda row: use(counts(row["text"], row["words"], row["lines"]))))


def counts(text: Column, words: Column, lines: Column) -> Counts:
    made = {
        "n_words": lambda: F.size(words),
        "word_chars": lambda: F.length(F.array_join(words, "")),
        "n_symbols": lambda: F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")),
        "n_lines": lambda: F.size(lines),
        "n_dup_lines": lambda: F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": lambda: repeated_words(words),
        "n_letter_words": lambda: F.size(F.filter(words, lambda w: w.rlike(r"\p{L}"))),
        "n_bullet_lines": lambda: F.size(F.filter(lines, lambda line: line.rlike(BULLET))),
        "n_cut_lines": lambda: F.size(F.filter(lines, lambda line: line.rlike(CUT))),
        "n_top_word": lambda: most_frequent(words),
    }
    return Counts({name: partial(lambda make: make().cast("bigint"), make) for name, make in made.items()}, {})


NAMES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def cascade_order(docs: DataFrame, rules: Sequence[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejection per cost, both measured on a sample of the documents."""
    picked = docs.select("doc_id", "text").filter(F.pmod(F.xxhash64("doc_id"), F.lit(16)) == 0).limit(sample_rows)
    sample = stored(picked)

    def run(fails: Callable[[Counts], Column]) -> tuple[float, float]:
        """The least time of some runs, and the share that fails."""
        took, total, failed = [], 0, 0
        for _ in range(SAMPLE_RUNS):
            began = time.perf_counter()
            total, failed = sample.agg(F.count("*"), F.count_if(measured(fails))).first()
            took.append(time.perf_counter() - began)
        return min(took), failed / total if total else 0.0

    bare, _ = run(lambda c: c["n_words"] + c["n_lines"] < 0)
    worth = []
    for rule in rules:
        cost, share = run(rule.fails)
        worth.append(share / max(cost - bare, 0.05 * bare))
    released(sample)
    return [rules[k] for k in sorted(range(len(rules)), key=lambda k: -worth[k])]


def first_failure(rules: Sequence[Rule], found: Counts) -> Column:
    """The name of the first rule in the given order that rejects; null if none does.  Later rules are not evaluated."""
    verdict = F.when(rules[0].fails(found), F.lit(rules[0].name))
    for rule in rules[1:]:
        verdict = verdict.when(rule.fails(found), F.lit(rule.name))
    return verdict


def keep(docs: DataFrame, rules: Sequence[Rule] = (*BASE, *RULES), sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that no rule rejects, with their own columns."""
    ordered = cascade_order(docs, rules, sample_rows)
    return docs.filter(measured(lambda found: first_failure(ordered, found)).isNull())


def judge(docs: DataFrame, base: Sequence[Rule] = BASE, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, every count of NAMES, base_failed, and kept (what the base rules and the cascade leave).

    The counts of NAMES are output and so are taken of every text; those that only
    the cascade needs are taken of a text that no rule before has rejected.
    """
    ordered = cascade_order(docs, rules, sample_rows)
    failed = lambda c: reduce(or_, (rule.fails(c) for rule in base))

    def verdict(found: Counts) -> Column:
        whole = F.struct(*(found[n].alias(n) for n in NAMES))
        return bind(whole, lambda c: decide(found.with_known({n: c[n] for n in NAMES})))

    def decide(found: Counts) -> Column:
        kept = F.when(failed(found), F.lit(False)).otherwise(first_failure(ordered, found).isNull())
        return F.struct(*(found[n].alias(n) for n in NAMES), failed(found).alias("base_failed"), kept.alias("kept"))

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), measured(verdict).alias("x")).select("doc_id", "x.*")


def counts_sql(table: str = "documents") -> str:
    """The counts in SQL."""
    return f"""
with t as (select row_number() over () as k, doc_id, coalesce(text, '') as text from {table}),
w as (select k, doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from t),
g as (select k, i, struct_pack(a := words[i], b := words[i + 1], c := words[i + 2]) as g from (select k, words, unnest(range(1, greatest(len(words) - 1, 1))) as i from w)),
d as (select k, i from (select k, i, count(*) over (partition by k, g) as n from g) where n > 1),
r as (select k, count(distinct i + o)::bigint as n_repeat_words from d, (values (0), (1), (2)) as x(o) group by k)
select doc_id, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols, len(lines)::bigint as n_lines,
  (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
  len(list_filter(words, lambda x: regexp_matches(x, '\\p{{L}}'))) as n_letter_words, len(list_filter(lines, lambda x: regexp_matches(x, '{BULLET}'))) as n_bullet_lines,
  len(list_filter(lines, lambda x: regexp_matches(x, '{CUT}'))) as n_cut_lines, coalesce(list_max(map_values(list_histogram(words))), 0) as n_top_word, w.k
from w left join r on w.k = r.k"""


def oracle(base: Sequence[Rule] = BASE, rules: Sequence[Rule] = RULES) -> str:
    failed = " or ".join(r.sql for r in base)
    return f"""
select doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, ({failed}) as base_failed,
  not ({failed}) and not ({" or ".join(r.sql for r in rules)}) as kept
from ({counts_sql()})"""
