"""URL filters: host and path rules first, then a weighted vocabulary of terms.

An Aho-Corasick automaton finds all terms in one pass over the URL, whose percent
signs are decoded and whose A-Z are lower-cased.  A hit counts if no ASCII letter
or digit stands beside it.  A strict term weighs as much as SOFT_LIMIT soft ones;
distinct terms of that weight together block the page.  The vocabulary is an
argument: a table of terms and their classes becomes one by `vocabulary`.

Defined results: a URL that is null or has no `://` has an empty host and path,
fits no rule, and is judged by its terms (null: allowed); repeated rows are each
judged; other columns play no part; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache, partial
from urllib.parse import unquote

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (rule, verdict): a host and the head of a path.
Rules = Sequence[tuple[str, str]]

RULES: Rules = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))

#: Terms of which one blocks.
STRICT = (
    "blackjack camgirl camgirls casino cialis deepfake escort escorts fentanyl gambling hentai jackpot keygen malware milf nsfw onlyfans "
    "phishing porn porno pornhub ransomware roulette sexcam slots spam sportsbook torrents trojan viagra warez xnxx xvideos xxx"
).split()
#: Terms of which SOFT_LIMIT distinct ones block.
SOFT = (
    "adult affiliate ads bet bets betting bingo bonus cheap clickbait clickhere coupon coupons crack cracked dating discount download earn "
    "escrow forex free freebie giveaway hookup hot loan loans lottery miracle nude nulled payday pills poker promo proxy replica rich "
    "sex sexy singles streaming tracker torrent vape voucher weightloss win winner"
).split()
SOFT_LIMIT = 2

#: A-Z to a-z.
LOWER = str.maketrans(dict(zip("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", strict=True)))
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


@cache
def _automaton(strict: tuple[str, ...], soft: tuple[str, ...]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for weight, terms in ((1, soft), (2, strict)):
        for term in terms:
            automaton.add_word(term, (len(term), term, weight))
    automaton.make_automaton()
    return automaton


def vocabulary(terms: DataFrame, most: int = 100_000) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(strict, soft) from a table (term, class); it is sent to every task, so one of over `most` terms is refused."""
    rows = terms.select(ascii_lower(F.col("term")).alias("term"), "class").filter("term <> ''").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} terms")
    return tuple(tuple(sorted(r["term"] for r in rows if r["class"] == kind)) for kind in ("strict", "soft"))


def term_hits(url: str, automaton: ahocorasick.Automaton) -> tuple[int, int]:
    """How many distinct strict and soft terms a URL holds as words."""
    url = unquote(url).translate(LOWER) if "%" in url else url
    hits = set()
    for end, (size, term, weight) in automaton.iter(url):
        if (end < size or url[end - size] not in _WORD) and (end + 1 == len(url) or url[end + 1] not in _WORD):
            hits.add((term, weight))
    strict = sum(weight == 2 for _, weight in hits)
    return strict, len(hits) - strict


def _judge(batches: Iterator[pa.RecordBatch], strict: tuple[str, ...], soft: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    automaton = _automaton(strict, soft)
    for batch in batches:
        hits = [term_hits(u or "", automaton) for u in batch.column("lowered").to_pylist()]
        counts = [pa.array([h[k] for h in hits], pa.int32()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *counts], names=[*batch.schema.names, "n_strict", "n_soft"])


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fitting_rule(host: Column, path: Column, rules: Rules) -> Column:
    """The longest rule whose host is `host` or a parent of it and whose path begins `path`."""
    fits = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        name, _, rest = rule.partition("/")
        here = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        fits = F.when(here, F.lit(rule)).otherwise(fits)
    return fits


def filter_urls(pages: DataFrame, rules: Rules = RULES, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """`page_id`, `url` -> page_id, host, path, rule, verdict, n_strict and n_soft (distinct terms)."""
    url = F.coalesce(F.col("url"), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    split = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)).alias("host"),
        F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("path"),
        ascii_lower(url).alias("lowered"),
    )
    hits = split.mapInArrow(partial(_judge, strict=tuple(strict), soft=tuple(soft)), "page_id bigint, host string, path string, lowered string, n_strict int, n_soft int")
    ruled = hits.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules))
    verdict = F.when((F.col("n_strict") > 0) | (F.col("n_soft") >= soft_limit), F.lit("block")).otherwise(F.lit("allow"))
    for rule, said in rules:
        verdict = F.when(F.col("rule") == rule, F.lit(said)).otherwise(verdict)
    return ruled.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "n_strict", "n_soft")


def oracle(rules: Rules = RULES, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, soft_limit: int = SOFT_LIMIT) -> str:
    """The same in SQL, with a regular expression for each term."""
    said = lambda term: f"regexp_matches(lowered, '(^|[^a-z0-9]){term}($|[^a-z0-9])')::int"
    fits = "null"
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        name, _, rest = rule.partition("/")
        fits = f"case when (host = '{name}' or ends_with(host, '.{name}')) and starts_with(path, '/{rest}') then '{rule}' else {fits} end"
    verdicts = " ".join(f"when rule = '{rule}' then '{said_}'" for rule, said_ in rules)
    upper = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    return f"""
with a as (select page_id, coalesce(url, '') as u from pages),
b as (select page_id, translate(url_decode(u), {upper}) as lowered, case when instr(u, '://') > 0 then substr(u, instr(u, '://') + 3) else '' end as rest from a),
c as (select page_id, lowered, translate(regexp_extract(rest, '^[^/?#]*'), {upper}) as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from b),
d as (select page_id, host, path, {fits} as rule, ({" + ".join(map(said, strict))}) as n_strict, ({" + ".join(map(said, soft))}) as n_soft from c)
select page_id, host, path, rule, case {verdicts} when n_strict > 0 or n_soft >= {soft_limit} then 'block' else 'allow' end as verdict, n_strict::int as n_strict, n_soft::int as n_soft
from d"""
