"""Repair of conversations: the cheapest edits that make the roles of a conversation legal.

Keep costs 0, Rerole (to user or assistant) 1, Delete 2, Insert (an empty user or
assistant turn) 5, and a truncated row that is not deleted 5 more; blank rows
and duplicates must go.  The roles left must read `(s?(ua)+)?`.  That language
has a machine of four states in which every edit leads to one state only, so the
costs to go are a vector of four numbers before each row, computed backwards,
and the edits come from a walk forwards that takes the ASCII-least tight one.

Vectors are kept at checkpoints only, about the square root of the rows apart;
the walk computes those of a stretch between two checkpoints again when it gets
there.  On Spark the rows are sorted by range into blocks of bounded size,
whatever the length of a conversation: inside a block every conversation has one
segment.  Only a conversation that crosses a block's border needs more: its
segments give min-plus matrices, whose products from the end are the vectors at
the borders (the outer checkpoints); its segments then map each state at their
start to one at their end, which gives the states at the borders; and with both
known, all segments are walked at once.  A conversation's digest alone is
computed in a row, over the repaired texts of its segments as they stream by.

Defined results: a null role or text is one space, in the damage's key also a
null conv_id or turn; a null conv_id is a conversation of its own; equal turns
are ordered by role and MD5 of the text; repeated rows are duplicates; a role
that is empty has no initial and can't be kept; other columns play no part; a
conversation without rows has zeros, an empty audit and the digest of the empty
string; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from math import isqrt

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.session import released, stored

#: Most rows and bytes of text in a block; one row may be larger.
BLOCK_ROWS, BLOCK_BYTES = 4096, 8 << 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
NONE, BLANK, DUPLICATE, CUT, GONE = range(5)
#: The machine: 0 before anything, 1 after system, 2 after user, 3 after assistant.  What an
#: inserted or reroled turn must be in each state, and the state it leads to.
WANTED, NEXT = ("u", "u", "a", "u"), (2, 2, 3, 2)
ROLES = {"u": "user", "a": "assistant"}
LEGAL = frozenset({"su", "ua", "au"})
NEVER = 1 << 40
SPACES = " \t\n\x0b\x0c\r"

Vector = tuple[int, int, int, int]


def closed(b0: int, b1: int, b2: int, b3: int) -> Vector:
    """The costs to go once turns may be inserted before the next row."""
    v2, v3 = min(b2, INSERT + b3), min(b3, INSERT + b2)
    return min(b0, INSERT + v2), min(b1, INSERT + v2), v2, v3


END = closed(0, NEVER, NEVER, 0)


def before(v: Vector, initial: str, fault: int) -> Vector:
    """The costs to go before a row, from those behind it."""
    d0, d1, d2, d3 = v[0] + DELETE, v[1] + DELETE, v[2] + DELETE, v[3] + DELETE
    if fault in (BLANK, DUPLICATE):
        return closed(d0, d1, d2, d3)
    more = TRUNCATED if fault == CUT else 0
    user = v[2] + more + (KEEP if initial == "u" else REROLE)
    assistant = v[3] + more + (KEEP if initial == "a" else REROLE)
    start = min(user, v[1] + more + KEEP) if initial == "s" else user
    return closed(min(d0, start), min(d1, user), min(d2, assistant), min(d3, user))


def matrix(rows: list[tuple[str, int]]) -> list[int]:
    """The min-plus matrix of a segment, row by row: cost from each state before it to each state behind it."""
    columns = []
    for j in range(4):
        v: Vector = tuple(0 if i == j else NEVER for i in range(4))
        for initial, fault in reversed(rows):
            v = before(v, initial, fault)
        columns.append(v)
    return [min(columns[j][i], NEVER) for i in range(4) for j in range(4)]


def times(m: list[int], v: Vector) -> Vector:
    return tuple(min(m[4 * i + j] + v[j] for j in range(4)) for i in range(4))


def walk(rows: list[tuple[str, int]], state: int, behind: Vector, last: bool) -> tuple[list[tuple[str, int, int]], int]:
    """The edits of a segment as (letter, row, state before it), and the state behind it.

    `behind` holds the costs to go behind the segment; insertions there belong to the next one, or to
    this one if it is the last.
    """
    n = len(rows)
    step = max(isqrt(n), 1)
    marks: dict[int, Vector] = {n: behind}
    v = behind
    for i in range(n - 1, -1, -1):
        v = before(v, *rows[i])
        if i % step == 0:
            marks[i] = v
    edits: list[tuple[str, int, int]] = []
    for low in range(0, n, step):
        high = min(low + step, n)
        stretch = [marks[high]]
        for i in range(high - 1, low - 1, -1):
            stretch.append(before(stretch[-1], *rows[i]))
        stretch.reverse()
        for i in range(low, high):
            here, there = stretch[i - low], stretch[i - low + 1]
            initial, fault = rows[i]
            while True:
                cost = here[state]
                if cost == there[state] + DELETE:
                    edits.append(("D", i, state))
                    break
                if cost == here[NEXT[state]] + INSERT:
                    edits.append(("I", i, state))
                    state = NEXT[state]
                    continue
                more = TRUNCATED if fault == CUT else 0
                after = 1 if state == 0 and initial == "s" else NEXT[state]
                if (initial == WANTED[state] or after == 1) and cost == there[after] + more + KEEP:
                    edits.append(("K", i, state))
                    state = after
                else:
                    edits.append(("R", i, state))
                    state = NEXT[state]
                break
    while last and END[state]:
        edits.append(("I", n, state))
        state = NEXT[state]
    return edits, state


def damaged(conversations: DataFrame) -> DataFrame:
    """`conv_id`, `turn`, `role`, `text` -> the rows after damage, as key, turn, role, text, gone (dropped rows stay, marked)."""
    blank = F.lit(" ")
    key = F.coalesce(F.col("conv_id").cast("bigint").cast("string"), blank)
    turn = F.col("turn").cast("bigint")
    rows = conversations.select(
        key.alias("key"),
        turn.alias("turn"),
        (F.crc32(F.concat(key, F.lit(":"), F.coalesce(turn.cast("string"), blank))) % 20).alias("draw"),
        F.coalesce("role", blank).alias("role"),
        F.coalesce("text", blank).alias("text"),
    )
    text = F.when(F.col("draw").isin(0, 1), "").when(F.col("draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("draw") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("draw") == 3, 2).otherwise(1))).alias("copy")
    return rows.select("key", "turn", role.alias("role"), text.alias("text"), (F.col("draw") == 0).alias("gone"), copies).drop("copy")


def _numbered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Adds `at`, which rises with the order of all rows, and `block`."""
    base = TaskContext.get().partitionId() << 33
    at = block = rows = held = 0
    for batch in batches:
        blocks = []
        for size in pc.binary_length(batch.column("text")).to_pylist():
            if rows and (rows == most or held + size > BLOCK_BYTES):
                block, rows, held = block + 1, 0, 0
            rows, held = rows + 1, held + size
            blocks.append(base + block)
        ats = pa.array(range(base + at, base + at + batch.num_rows), pa.int64())
        at += batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, ats, pa.array(blocks, pa.int64())], names=[*batch.schema.names, "at", "block"])


def ordered(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows of `damaged` in order of key and turn, numbered and in blocks; stored."""
    marked = rows.withColumn("mark", F.unhex(F.md5("text")))
    order = marked.orderBy("key", F.asc_nulls_first("turn"), "role", "mark", "gone")
    return stored(order.mapInArrow(partial(_numbered, most=block_rows), "key string, turn bigint, role string, text string, gone boolean, mark binary, at bigint, block bigint"))


def coded(rows: DataFrame) -> DataFrame:
    """block, at, key, initial, fault, has_turn and turn of rows of `ordered`.

    The first of equal rows is found by an aggregate with its partial sums before the shuffle, and
    joined by its number, which is unique, so that a hot text or conversation is no hot key.
    """
    firsts = rows.filter("not gone").groupBy("key", "role", "mark").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    kept = F.rtrim("text", F.lit(SPACES))
    fault = (
        F.when(F.col("gone"), GONE)
        .when(kept == "", BLANK)
        .when(F.col("first").isNull(), DUPLICATE)
        .when(~F.right(kept, F.lit(1)).isin(".", "!", "?"), CUT)
        .otherwise(NONE)
    )
    narrow = rows.select("block", "at", "key", F.substring("role", 1, 1).alias("initial"), F.col("turn").isNotNull().alias("has_turn"), F.coalesce("turn", F.lit(0)).alias("turn"), "gone", kept.alias("kept"))
    faults = fault.alias("fault")
    small = narrow.withColumn("kept", F.when(narrow["kept"] == "", "").otherwise(F.right("kept", F.lit(1))))
    joined = small.join(firsts, "at", "left").withColumn("text", F.col("kept"))
    return joined.select("block", "at", "key", "initial", "has_turn", "turn", faults)


def _segments(frame: pd.DataFrame) -> Iterator[tuple[str, pd.DataFrame]]:
    """The rows of each key of a block, which is in order."""
    keys = frame["key"].to_numpy()
    starts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)] if len(keys) else [0]
    for a, b in zip(starts, starts[1:], strict=False):
        yield keys[a], frame.iloc[a:b]


def _living(part: pd.DataFrame) -> list[tuple[str, int]]:
    return [(i, f) for i, f in zip(part["initial"], part["fault"], strict=True) if f != GONE]


def _borders(block: pd.DataFrame) -> pd.DataFrame:
    """The matrices of a block's first and last segments."""
    found = list(_segments(block.sort_values("at")))
    ends = found if len(found) < 2 else [found[0], found[-1]]
    return pd.DataFrame([(key, part["block"].iloc[0], matrix(_living(part))) for key, part in ends], columns=["key", "block", "costs"])


def _vectors(parts: pd.DataFrame) -> pd.DataFrame:
    """Costs to go behind each segment of one key that has several, and whether it is the last."""
    out, v = [], END
    parts = parts.sort_values("block", ascending=False)
    if len(parts) > 1:
        for k, (key, block, costs) in enumerate(zip(parts["key"], parts["block"], parts["costs"], strict=True)):
            out.append((key, block, list(v), k == 0))
            v = times([int(c) for c in costs], v)
    return pd.DataFrame(out, columns=["key", "block", "behind", "last"])


def _moves(block: pd.DataFrame, behind: pd.DataFrame) -> pd.DataFrame:
    """To which state each state before a border segment leads."""
    rows = {key: part for key, part in _segments(block.sort_values("at"))} if len(behind) else {}
    out = []
    for key, number, v, last in zip(behind["key"], behind["block"], behind["behind"], behind["last"], strict=True):
        living, v = _living(rows[key]), tuple(int(c) for c in v)
        out.append((key, number, list(v), last, [walk(living, s, v, last)[1] if times(matrix(living), v)[s] < NEVER else s for s in range(4)]))
    return pd.DataFrame(out, columns=["key", "block", "behind", "last", "leads"])


def _states(parts: pd.DataFrame) -> pd.DataFrame:
    """The state before each segment of one key."""
    parts = parts.sort_values("block")
    states, s = [], 0
    for leads in parts["leads"]:
        states.append(s)
        s = int(leads[s])
    return parts.assign(state=states)[["key", "block", "behind", "last", "state"]]


PARTS = "key string, block bigint, whole boolean, n bigint, low bigint, high bigint, turns bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, head string, tail string, cost bigint, audit string, lines bigint, repaired string, repaired_sha256 string"
_NAMES = [c.split()[0] for c in PARTS.split(", ")]


def _segment(key: str, part: pd.DataFrame, place: tuple[Vector, bool, int] | None) -> tuple:
    part = part[part["fault"] != GONE]
    initials, faults = part["initial"].tolist(), part["fault"].tolist()
    behind, last, state = place or (END, True, 0)
    edits, _ = walk(list(zip(initials, faults, strict=True)), state, behind, last)
    roles, texts = part["role"].tolist(), part["text"].tolist()
    lines, cost = [], 0
    for letter, i, s in edits:
        if letter == "D":
            cost += DELETE
        elif letter == "I":
            cost += INSERT
            lines.append(ROLES[WANTED[s]] + ":")
        else:
            cost += (REROLE if letter == "R" else KEEP) + (TRUNCATED if faults[i] == CUT else 0)
            lines.append(f"{ROLES[WANTED[s]] if letter == 'R' else roles[i]}:{texts[i]}")
    repaired = "\n".join(lines)
    timed = part["turn"][part["has_turn"]]
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
    ends = (int(timed.iloc[0]), int(timed.iloc[-1])) if len(timed) else (None, None)
    counts = [faults.count(f) for f in (BLANK, DUPLICATE, CUT)]
    whole = place is None
    return (
        key, 0, whole, len(part), *ends, timed.nunique(), *counts, illegal, initials[0] if initials else None, initials[-1] if initials else None,
        cost, "".join(e[0] for e in edits), len(lines), None if whole else repaired, hashlib.sha256(repaired.encode()).hexdigest() if whole else None,
    )


def _walked(block: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
    """A row of PARTS for each segment of a block, from its texts, the codes of its rows and the places of its border segments."""
    codes = side[side["at"] >= 0].sort_values("at")
    texts = block.sort_values("at").reset_index(drop=True)
    for c in ("initial", "fault"):
        texts[c] = codes[c].to_numpy()
    places = {k: (tuple(int(c) for c in v), bool(last), int(s)) for k, v, last, s in side[side["at"] < 0][["key", "behind", "last", "state"]].itertuples(index=False)}
    number = texts["block"].iloc[0] if len(texts) else 0
    out = [_segment(key, part, places.get(key)) for key, part in _segments(texts)]
    found = pd.DataFrame(out, columns=_NAMES).astype({"low": "Int64", "high": "Int64"})
    return found.assign(block=number)


class _Merge:
    """The segments of one conversation, put together as they stream by."""

    def __init__(self, key: str):
        self.key, self.low, self.high, self.turns, self.tail, self.first = key, None, None, 0, None, True
        self.n = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.audit: list[str] = []
        self.hash = hashlib.sha256()

    def add(self, p) -> None:
        if not pd.isna(p.low):
            self.turns += int(p.turns) - (self.high == p.low)
            self.low, self.high = p.low if self.low is None else self.low, p.high
        for name in ("n", "blank", "duplicate", "truncated", "illegal", "cost"):
            setattr(self, name, getattr(self, name) + int(getattr(p, name)))
        if p.n:
            self.illegal += self.tail is not None and self.tail + p.head not in LEGAL
            self.tail = p.tail
        self.audit.append(p.audit)
        if p.lines:
            self.hash.update((("" if self.first else "\n") + p.repaired).encode())
            self.first = False

    def row(self) -> tuple:
        gaps = 0 if self.low is None else int(self.high) - int(self.low) + 1 - self.turns
        return self.key, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


MERGED = "key string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def _merged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in MERGED.split(", ")]
    now: _Merge | None = None
    for frame in frames:
        done = []
        for p in frame.astype({"low": "Int64", "high": "Int64"}).itertuples(index=False):
            if now is None or p.key != now.key:
                if now is not None:
                    done.append(now.row())
                now = _Merge(p.key)
            now.add(p)
        yield pd.DataFrame(done, columns=names)
    if now is not None:
        yield pd.DataFrame([now.row()], columns=names)


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows as of `damaged` -> conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    texts = ordered(rows, block_rows)
    codes = stored(coded(texts))
    borders = codes.groupBy("block").applyInPandas(_borders, "key string, block bigint, costs array<bigint>")
    vectors = borders.groupBy("key").applyInPandas(_vectors, "key string, block bigint, behind array<bigint>, last boolean")
    moves = codes.groupBy("block").cogroup(vectors.groupBy("block")).applyInPandas(_moves, "key string, block bigint, behind array<bigint>, last boolean, leads array<int>")
    states = moves.groupBy("key").applyInPandas(_states, "key string, block bigint, behind array<bigint>, last boolean, state int")
    places = states.select("*", F.lit(-1).cast("bigint").alias("at"), F.lit("").alias("initial"), F.lit(GONE).alias("fault"))
    side = codes.select("block", "at", "initial", "fault").unionByName(places, allowMissingColumns=True)
    wanted = texts.select("block", "at", "key", "role", "text", F.col("turn").isNotNull().alias("has_turn"), F.coalesce("turn", F.lit(0)).alias("turn"))
    parts = stored(wanted.groupBy("block").cogroup(side.groupBy("block")).applyInPandas(_walked, PARTS))
    released(texts, codes)
    gaps = F.when(F.col("low").isNull(), 0).otherwise(F.col("high") - F.col("low") + 1 - F.col("turns"))
    single = parts.filter("whole").withColumn("gaps", gaps).select(*(c.split()[0] for c in MERGED.split(", ")))
    several = parts.filter("not whole").drop("whole", "repaired_sha256").repartition("key").sortWithinPartitions("key", "block").mapInPandas(_merged, MERGED)
    return single.unionByName(several).select(F.expr("try_cast(key as bigint)").alias("conv_id"), "*").drop("key")


ORACLE = r"""
with recursive
crc(b, k, c) as (
  select b, 0, b::bigint from range(256) as r(b)
  union all select b, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from crc where k < 8),
crcs as (select list(c order by b) as tab from crc where k = 8),
given as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as name
  from conversations),
drawn as (
  select g.*, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(name) + 1), lambda i: ascii(substr(name, i::int, 1))::bigint)),
    lambda acc, x: xor(acc >> 8, tab[(xor(acc, x) & 255) + 1]))) % 20 as draw
  from given g, crcs),
hit as (
  select conv_id, turn, case when draw = 4 then 'user' else role end as role,
    case when draw = 1 then '' when draw = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from drawn, (select unnest([1, 2]) as copy) where draw <> 0 and (copy = 1 or draw = 3)),
numbered as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(text)) as i,
    regexp_replace(text, '[ \t\n\x0B\f\r]+$', '') as kept
  from hit),
seen as (
  select conv_id, turn, role, text, i, left(role, 1) as c, lag(left(role, 1)) over (partition by conv_id order by i) as p,
    case when kept = '' then 1 when row_number() over (partition by conv_id, role, text order by i) > 1 then 2 when right(kept, 1) not in ('.', '!', '?') then 3 else 0 end as f
  from numbered),
sizes as (select conv_id, max(i) as n from seen group by conv_id),
costs(conv_id, i, v0, v1, v2, v3) as (
  select conv_id, n + 1, 0, 10, 5, 0 from sizes
  union all
  select conv_id, i, least(b0, 5 + least(b2, 5 + b3)), least(b1, 5 + least(b2, 5 + b3)), least(b2, 5 + b3), least(b3, 5 + b2)
  from (
    select conv_id, i, least(v0 + 2, case when f in (1, 2) then 1000000000 else least(u, case when c = 's' then v1 + m else 1000000000 end) end) as b0,
      least(v1 + 2, case when f in (1, 2) then 1000000000 else u end) as b1, least(v2 + 2, case when f in (1, 2) then 1000000000 else a end) as b2,
      least(v3 + 2, case when f in (1, 2) then 1000000000 else u end) as b3
    from (
      select k.conv_id, s.i, k.v0, k.v1, k.v2, k.v3, s.c, s.f, case when f = 3 then 5 else 0 end as m,
        k.v2 + case when f = 3 then 5 else 0 end + case when c = 'u' then 0 else 1 end as u, k.v3 + case when f = 3 then 5 else 0 end + case when c = 'a' then 0 else 1 end as a
      from costs k join seen s on s.conv_id is not distinct from k.conv_id and s.i = k.i - 1))),
tight as (select conv_id, i, [v0, v1, v2, v3]::bigint[] as v from costs),
walks(conv_id, i, s, done, cost, audit, lines) as (
  select conv_id, 1::bigint, 0, false, 0::bigint, '', []::varchar[] from sizes
  union all
  select conv_id, case when e in ('I', '') then i else i + 1 end, case when e in ('D', '') then s when e = 'K' and s = 0 and c = 's' then 1 else [2, 2, 3, 2][s + 1] end, e = '',
    cost + case e when 'D' then 2 when 'I' then 5 when 'K' then m when 'R' then m + 1 else 0 end, audit || e,
    case when e = 'K' then list_append(lines, role || ':' || text) when e = 'R' then list_append(lines, w || ':' || text) when e = 'I' then list_append(lines, w || ':') else lines end
  from (
    select *, case when there is null and here[s + 1] = 0 then '' when there[s + 1] + 2 = here[s + 1] then 'D' when here[[2, 2, 3, 2][s + 1] + 1] + 5 = here[s + 1] then 'I'
      when c = w[1] and there[[2, 2, 3, 2][s + 1] + 1] + m = here[s + 1] or s = 0 and c = 's' and there[2] + m = here[1] then 'K' else 'R' end as e
    from (
      select k.*, h.v as here, t.v as there, r.c, r.role, r.text, case when r.f = 3 then 5 else 0 end as m, case when k.s = 2 then 'assistant' else 'user' end as w
      from walks k join tight h on h.conv_id is not distinct from k.conv_id and h.i = k.i
      left join tight t on t.conv_id is not distinct from k.conv_id and t.i = k.i + 1
      left join seen r on r.conv_id is not distinct from k.conv_id and r.i = k.i
      where not k.done))),
counted as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (f = 1) as blank, count(*) filter (f = 2) as duplicate,
    count(*) filter (f = 3) as truncated, count(*) filter (p || c not in ('su', 'ua', 'au')) as illegal
  from seen group by conv_id)
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(cost, 0) as cost, coalesce(audit, '') as audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) o
left join counted d on d.conv_id is not distinct from o.conv_id
left join walks w on w.conv_id is not distinct from o.conv_id and w.done"""
