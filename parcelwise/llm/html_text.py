"""Main text of web pages by equivalence classes of tokens across the pages of a host.

A token is a tag or a run of text, told apart by its path of elements and
classes.  Its occurrence vector says how often it stands in each page of a host.
Vectors are never built: each page has a random number, and the sum of a
token's counts times these numbers is the same for two tokens only if their
vectors are (two sums of 28-bit numbers, the pages and the occurrences must all
agree), so that the sums are made inside tasks and added before the shuffle, and
a host with a third of all pages is no hot key.

Tokens of one vector that stand in enough pages of the host are a class.  A
class is valid if its tokens come in one and the same order in every page, over
and over, and if each round lies in one gap of the host's outermost class.  The
valid classes, nested so, are the template; what stands between its tokens are
the slots.  Text that belongs to the template goes; so do slots inside elements
that by name or class hold menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles or readers' comments.  Where a page has an `article` or
`main`, its slots alone are the main text, and text in them stays even if other
pages have it too (copies of an article are no template).

Defined results: null html counts as empty and gives an empty text; a null or
odd url has no host, and a host with few pages no template, so that its pages'
own elements decide alone; a text token counts as template only in a class with
a tag; if nothing but template text were left, that text stays; headings inside
an article's own header stay; a tag that is cut off by the end of the page is markup; `br` is white space, other block elements end a
block; blocks are trimmed and joined by one line feed, white space is that of
Unicode; repeated rows each have their result; other columns play no part; an
empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.llm.ragged import blocks
from parcelwise.session import released, stored

#: A class stands in at least so many pages of its host, and in such a share of them.
LEAST_PAGES, LEAST_SHARE = 3, 0.5
#: Templates of so many tokens in all are broadcast (about 16 bytes each); larger ones are joined by a shuffle.
BROADCAST_TOKENS = 2_000_000
BITS = 28

# fixed values: elements of HTML by their role
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe noembed noframes xmp svg".split())
MAIN = frozenset(("article", "main"))
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
JUNK = frozenset("head title script style noscript template iframe object svg canvas audio video nav footer aside form menu dialog button select textarea".split())
#: A start tag ends an open element of the first set, unless one of the second lies between.
ENDS = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))),
    "dd": (frozenset(("dd", "dt")), frozenset(("dl",))),
    "dt": (frozenset(("dd", "dt")), frozenset(("dl",))),
    "tr": (frozenset(("tr",)), frozenset(("table",))),
    "td": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "th": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "option": (frozenset(("option",)), frozenset(("select",))),
}
SCOPE = frozenset("table td th caption button object html".split())
#: Words of class, id and role that mark an element as no part of the main text.
JUNK_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup share sharing social related recommended comment comments disqus respond reply replies search searchbox login widget toolbar pagination pager skip complementary contentinfo".split()
)
HEADER_WORDS = frozenset(("header",))

_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|</?[a-zA-Z][^>]*>?""", re.DOTALL)
_NAMING = re.compile(r"""(?:^|\s)(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Place(NamedTuple):
    """Where a token stands: its path, and what the open elements say about it."""

    path: int
    junk: str
    main: bool
    heading: bool
    link: bool


class Token(NamedTuple):
    """A tag (text null; `ends`: it ends a block; "br" is white space) or a run of text."""

    key: int
    text: str | None
    place: Place
    ends: bool


def _hash(text: str, seed: int) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed) - (1 << 63)


@lru_cache(1 << 16)
def _naming(attributes: str) -> tuple[str, frozenset[str], bool]:
    """The class, the words of class, id and role, and whether the element says that it is the main text."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _NAMING.finditer(attributes)}
    words = {w.lower() for name in ("class", "id", "role") for w in _WORD.findall(found.get(name, ""))}
    return found.get("class", ""), frozenset(words), found.get("role", "").lower() == "main" or found.get("itemprop", "") == "articleBody"


@lru_cache(1 << 16)
def _inner(place: Place, name: str, attributes: str) -> Place:
    """The place inside a new element."""
    kind, words, says_main = _naming(attributes) if attributes else ("", frozenset(), False)
    main = name in MAIN or says_main
    junk = place.junk
    if main and junk == "form":
        junk = ""
    if not junk and name not in ("html", "body"):
        if name in JUNK or (words & JUNK_WORDS and not main):
            junk = "form" if name == "form" else "junk"
        elif name == "header" or words & HEADER_WORDS:
            junk = "header"
    elif junk == "header" and (name in JUNK or words & JUNK_WORDS):
        junk = "junk"
    path = _hash(f"{name} {kind}", place.path & (1 << 64) - 1)
    return Place(path, junk, place.main or main, place.heading or name in HEADING, place.link or name == "a")


OUTSIDE = Place(0, "", False, False, False)


def tokens(page: str) -> list[Token]:
    """The tags and runs of text of a page, in order.

    Elements whose end tags may be left out are ended as browsers do; an end tag without a start is
    a token of its place, but ends nothing.
    """
    out: list[Token] = []
    stack: list[tuple[str, Place]] = []
    place, at, size = OUTSIDE, 0, len(page)

    def text(run: str) -> None:
        shown = " ".join(run.split())
        out.append(Token(_hash(shown, (place.path + 2) & (1 << 64) - 1) if shown else 0, run, place, False))

    def close(depth: int) -> Place:
        del stack[depth:]
        return stack[-1][1] if stack else OUTSIDE

    def nearest(names: frozenset[str], bounds: frozenset[str]) -> int:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                return i
            if stack[i][0] in bounds:
                break
        return -1

    while at < size:
        found = _MARKUP.search(page, at)
        if found is None:
            text(page[at:])
            break
        if found.start() > at:
            text(page[at : found.start()])
        at = found.end()
        if not found[2]:
            continue
        name, ends = found[2].lower(), False
        if found[1]:
            depth = nearest(frozenset((name,)), frozenset() if name in BLOCK else BLOCK)
            out.append(Token(_hash("/" + name, place.path & (1 << 64) - 1) if depth < 0 else stack[depth][1].path ^ 1, None, place, name in BLOCK))
            if depth >= 0:
                place = close(depth)
            continue
        if name in BLOCK:
            ends = True
            depth = nearest(frozenset(("p",)), SCOPE)
            if depth >= 0:
                place = close(depth)
        if name in ENDS:
            depth = nearest(*ENDS[name])
            if depth >= 0:
                place = close(depth)
        inner = _inner(place, name, found[3])
        out.append(Token(inner.path, " " if name == "br" else None, place, ends))
        if name in RAW:
            end = re.compile(f"</{name}", re.IGNORECASE).search(page, at)
            at = size if end is None else end.start()
        if name not in VOID and not found[3].endswith("/"):
            stack.append((name, inner))
            place = inner
    return out


def _statistic(token: Token) -> bool:
    """Tags, and text that the template can decide about: text of articles and of junk is decided by its place."""
    return token.text is None or (token.key != 0 and not token.place.main and not token.place.junk and token.text != " ")


def _number(page_id: object, page: str) -> tuple[int, int]:
    """The random numbers of a page."""
    h = xxhash.xxh64_intdigest(f"{page_id}\0{page}".encode("utf-8", "surrogatepass"))
    return h & ((1 << BITS) - 1), h >> (64 - BITS)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    for batch in batches:
        for block in blocks(iter([batch]), "html"):
            yield block.to_pylist()


COUNTS = "host string, token bigint, tag boolean, one bigint, two bigint, pages bigint, total bigint"


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "int": pa.int32()}
    fields = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors of the tokens of a block's pages, as sums; token 0 counts the pages themselves."""
    for rows in _rows(batches):
        sums: dict[tuple[str, int, bool], list[int]] = {}
        for row in rows:
            page = row["html"] or ""
            one, two = _number(row["page_id"], page)
            counts = Counter((t.key, t.text is None) for t in tokens(page) if _statistic(t))
            counts[(0, True)] = 1
            for (key, tag), n in counts.items():
                sum_ = sums.setdefault((row["host"], key, tag), [0, 0, 0, 0])
                sum_[0] += one * n
                sum_[1] += two * n
                sum_[2] += 1
                sum_[3] += n
        yield _table([(*k, *v) for k, v in sums.items()], COUNTS)


def classes(pages: DataFrame) -> DataFrame:
    """page_id, host, html -> host, token, tag, class and outer: tokens of classes that stand in enough pages of their host.

    A class is numbered by its vector; the host's outermost class is that of most pages, fewest
    occurrences and most tokens.  A host has at most (tokens of a page / LEAST_SHARE) such tokens.
    """
    counts = pages.filter("host <> ''").mapInArrow(_counted, COUNTS).groupBy("host", "token", "tag").agg(*(F.sum(c).alias(c) for c in ("one", "two", "pages", "total")))
    counts = stored(counts)
    hosts = counts.filter("token = 0 and tag").select("host", F.col("pages").alias("all"))
    enough = (F.col("pages") >= LEAST_PAGES) & (F.col("pages") >= LEAST_SHARE * F.col("all"))
    kept = counts.filter("not (token = 0 and tag)").join(hosts, "host").filter(enough)
    vector = F.struct("pages", "total", "one", "two")
    sizes = kept.groupBy("host", vector.alias("vector")).agg(F.count("*").alias("size"), F.max("tag").alias("tagged"))
    outer = sizes.filter("tagged").groupBy("host").agg(F.max(F.struct("vector.pages", -F.col("vector.total"), "size", "vector")).alias("o")).select("host", F.col("o.vector").alias("outer"))
    found = kept.withColumn("vector", vector).join(sizes.filter("tagged"), ["host", "vector"]).join(outer, "host")
    out = stored(found.select("host", "token", F.xxhash64("vector").alias("class"), (F.col("vector") == F.col("outer")).alias("outer")))
    released(counts)
    return out


def by_host(found: DataFrame) -> DataFrame:
    """A row for each host: its tokens, their classes, and which are outermost."""
    lists = F.sort_array(F.collect_list(F.struct("token", "class", "outer")))
    return found.groupBy("host").agg(lists.alias("t")).select("host", *(F.col(f"t.{c}").alias(f"{c}_list") for c in ("token", "class", "outer")))


def with_lists(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Pages with the lists of their hosts: broadcast up to BROADCAST_TOKENS, else by a join that splits hot hosts."""
    lists = by_host(found)
    small = found.limit(BROADCAST_TOKENS + 1).count() <= BROADCAST_TOKENS
    return pages.join(F.broadcast(lists) if small else lists, "host", "left")


class _Hosts:
    """The lists of the hosts that a task meets, as dictionaries; those of the last HELD hosts are kept."""

    HELD = 1000

    def __init__(self):
        self.held: dict[str, tuple[dict[int, int], int | None]] = {}
        self.of: dict[int, int] = {}
        self.outer: int | None = None

    def turn(self, row: dict) -> None:
        host = row["host"]
        if host not in self.held:
            if len(self.held) == self.HELD:
                self.held.clear()
            keys, kinds, outer = (row[f"{c}_list"] or [] for c in ("token", "class", "outer"))
            self.held[host] = dict(zip(keys, kinds, strict=True)), next((c for c, o in zip(kinds, outer, strict=True) if o), None)
        self.of, self.outer = self.held[host]


ORDERS = "host string, class bigint, bad bigint, low bigint, high bigint"


def order_of(places: list[tuple[int, int]]) -> int | None:
    """The order in which a class's tokens come, as a number; None if they don't come in one order over and over, or a round crosses a gap."""
    size = len({key for key, _ in places})
    round_ = [key for key, _ in places[:size]]
    if len(set(round_)) < size or len(places) % size:
        return None
    for i in range(0, len(places), size):
        part = places[i : i + size]
        if [key for key, _ in part] != round_ or part[0][1] != part[-1][1]:
            return None
    return xxhash.xxh64_intdigest(np.array(round_, np.int64).tobytes()) >> 2


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each class of a block's pages, in how many it is out of order, and the least and greatest order."""
    hosts = _Hosts()
    for rows in _rows(batches):
        orders: dict[tuple[str, int], list[int]] = {}
        for row in rows:
            hosts.turn(row)
            if not hosts.of:
                continue
            gap, places = 0, {}
            for t in tokens(row["html"] or ""):
                kind = hosts.of.get(t.key) if _statistic(t) else None
                if kind is None:
                    continue
                if kind == hosts.outer:
                    gap += 1
                places.setdefault(kind, []).append((t.key, 0 if kind == hosts.outer else gap))
            for kind, found in places.items():
                order = order_of(found)
                seen = orders.setdefault((row["host"], kind), [0, 1 << 62, -1])
                if order is None:
                    seen[0] += 1
                else:
                    seen[1], seen[2] = min(seen[1], order), max(seen[2], order)
        yield _table([(*k, v[0], v[1], v[2]) for k, v in orders.items()], ORDERS)


def template(pages: DataFrame) -> DataFrame:
    """host, token, class, outer of the valid classes of every host; stored."""
    found = classes(pages)
    checked = with_lists(pages, found).mapInArrow(_checked, ORDERS).groupBy("host", "class").agg(F.sum("bad").alias("bad"), F.min("low").alias("low"), F.max("high").alias("high"))
    valid = stored(found.join(checked.filter("bad = 0 and low = high").select("host", "class"), ["host", "class"], "left_semi"))
    released(found)
    return valid


def slots(page: list[Token], known: dict[int, int]) -> list[list[Token]]:
    """What stands between the tokens of the template, in order; template text goes with the template."""
    out: list[list[Token]] = [[]]
    for t in page:
        if _statistic(t) and t.key in known:
            # a template tag opens the next slot and still ends a block there; template text leaves a gap
            out.append([t] if t.text is None else [])
        else:
            out[-1].append(t)
    return out


def _wanted(place: Place, has_main: bool) -> bool:
    if has_main and not place.main:
        return False
    return not place.junk or (place.junk == "header" and place.main and place.heading)


def _blocks(parts: list[list[Token]], has_main: bool) -> list[str]:
    """The text blocks of slots; outside of articles a block of links alone is a menu."""
    out: list[str] = []
    runs: list[str] = []
    linked = True

    def end() -> None:
        nonlocal linked
        block = " ".join(entities.unescape("".join(runs)).split())
        if block and (has_main or not linked):
            out.append(block)
        runs.clear()
        linked = True

    for part in parts:
        for t in part:
            if t.ends:
                end()
            elif t.text is not None:
                if _wanted(t.place, has_main):
                    runs.append(t.text)
                    linked = linked and (t.place.link or not t.text.strip())
    end()
    return out


def main_text(page: str, known: dict[int, int] | None = None) -> str:
    """The main text of a page, with the tokens of its host's template."""
    found = tokens(page)
    has_main = any(t.place.main for t in found)
    blocks_ = _blocks(slots(found, known or {}), has_main)
    if not blocks_ and known:
        blocks_ = _blocks([found], has_main)
    return "\n".join(blocks_)


EXTRACTED = "page_id bigint, url string, text string, n_chars bigint"


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hosts = _Hosts()
    for rows in _rows(batches):
        out = []
        for row in rows:
            hosts.turn(row)
            text = main_text(row["html"] or "", hosts.of)
            out.append((row["page_id"], row["url"], text, len(text)))
        yield _table(out, EXTRACTED)


def extract(pages: DataFrame) -> DataFrame:
    """`page_id`, `url`, `html` -> page_id, url, text, n_chars."""
    url = F.coalesce("url", F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    hosted = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html", F.lower(F.regexp_extract(rest, r"^[^/?#]*", 0)).alias("host"))
    return with_lists(hosted, template(hosted)).mapInArrow(_extracted, EXTRACTED)
