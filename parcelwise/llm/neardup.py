"""Near duplicates by BagMinHash: weighted Jaccard similarity of word shingles.

A document is the multiset of its shingles of five words.  Its signature: every
shingle throws points of a Poisson process, in time and over the registers, for
each unit of its weight; a register keeps the earliest time it gets.  The units
are gathered in dyadic intervals (0,1], (1,2], (2,4], (4,8] ... whose processes
have the interval's length as rate; in an interval that the weight fills in part
a point counts only if its cell lies below the weight.  Two signatures agree in
a register with the probability of the weighted Jaccard similarity.  All points
up to the time at which a text's registers are full are drawn by whole arrays.

Steps, each of at most one comparison a document but the last:

1. Exact copies meet by a digest of the text, and one of them stands for all.
2. Bands of registers give buckets, each with a centre: its document that lies
   in the fullest buckets.  A document is compared with one of the centres of
   its buckets, the one it meets most often.
3. Links make classes.  In buckets that hold several classes, a document outside
   the largest is compared with one of that class, again the one met most often.
4. The documents of buckets that still hold several classes are joined exactly:
   similar ones must share a shingle among the first few of each, the rarest
   first, and near enough to the front (prefix and position filter).  So no link
   between classes of a bucket is lost, and a group of many texts that are
   alike but not similar makes few pairs.

A comparison is the overlap of the multisets themselves.  The text that many
are compared with is sent once to each slice of at most SLICE of them.

48 bands of 8 registers miss a pair of similarity 0.8 with probability 1.5e-4,
one of 0.85 with 2e-7.  Long bands keep texts that share but a passage apart.

Defined results: null counts as an empty text; a text without a word resembles
its exact copies alone, one of fewer than five words has one shingle of them
all; a document is its text, whatever its doc_id: rows that share a doc_id, null
included, are not joined by it; a class is named by its smallest doc_id, null
before all others, and as classes can share that name, told apart by class_key;
exactly one row of each class is kept, one with the class's name; other columns
play no part; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.llm import ragged
from parcelwise.session import released, stored

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 48, 8
REGISTERS = BANDS * ROWS
#: Texts that are compared with one text in one group.
SLICE = 1000
#: Bytes of text that are signed or compared at once.
BLOCK = 1 << 20
#: Points that are drawn at once.
POINTS = 1 << 14
#: Counters of shingles (8 MB in all, whatever their number); they only order the shingles.
COUNTERS = 1 << 20
#: Bitmaps of 4 kB that mark wanted ids (1 MB in all, whatever their number).
MARKS = 256

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The multisets of a column of texts: (row, shingle hash, weight), in no order."""
    text = ragged.Codes(*ragged.utf8(column))
    begin, end = ragged.runs(text, ragged.ascii_space_classes()[text.codes], ragged.LETTER)
    row = ragged.rows_of(begin, text.rows)
    first, last = text.byte(begin), text.byte(end)
    words = ragged.hash_ranges(text.data, first, last - first)
    counts = np.bincount(row, minlength=len(column))
    starts = np.cumsum(counts) - counts
    windows = np.where(counts > 0, np.maximum(counts - size + 1, 1), 0)
    at = np.repeat(starts - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
    owner = np.repeat(np.arange(len(column)), windows)
    ends = (starts + counts)[owner]
    value = np.full(len(at), size, np.uint64)
    for k in range(size):
        inside = at + k < ends
        value = ragged.mix(value * _GOLD + np.where(inside, words[np.minimum(at + k, max(len(words) - 1, 0))] if len(words) else np.uint64(0), np.uint64(0)))
    keyed = ragged.mix(value + owner.astype(np.uint64) * _GOLD)
    order = np.argsort(keyed)
    keyed = keyed[order]
    head = np.flatnonzero(np.concatenate([np.ones(min(1, len(keyed)), bool), keyed[1:] != keyed[:-1]]))
    sample = order[head]
    return owner[sample], value[sample], np.diff(np.append(head, len(keyed)))


def signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, n_rows: int, registers: int = REGISTERS) -> np.ndarray:
    """The earliest time in each register of each row; infinite for a row without elements."""
    out = np.full((n_rows, registers), np.inf)
    total = np.bincount(row, weights=weight, minlength=n_rows)
    horizon = (np.log(registers) + 3.0) / np.maximum(total, 1)
    todo = total > 0
    while todo.any():
        _throw(out, row, element, weight, horizon, todo[row])
        todo &= np.isinf(out).any(axis=1)
        horizon[todo] *= 2
    return out


def _throw(out: np.ndarray, row: np.ndarray, element: np.ndarray, weight: np.ndarray, horizon: np.ndarray, use: np.ndarray) -> None:
    """All points up to each row's horizon, into the registers."""
    registers = out.shape[1]
    level = 0
    low32 = np.uint64(0xFFFFFFFF)
    while use.any():
        low, length = (0, 1) if level == 0 else (1 << (level - 1), 1 << (level - 1))
        use = use & (weight > low)
        own, most = row[use], weight[use] - low
        first, last = own * registers, horizon[own] * (length * registers)
        base = ragged.mix(element[use] + ragged.mix(np.array([level + 1], np.uint64)))
        time, drawn = np.zeros(len(own)), 0
        while len(time):
            # a point at a time for each of many shingles, many for each of few
            some = min(512, max(1, POINTS // len(time)))
            state = ragged.mix(base[:, None] + np.arange(drawn + 1, drawn + some + 1, dtype=np.uint64) * _GOLD)
            gaps = -np.log(((state >> np.uint64(11)) + np.uint64(1)).astype(float) * 2.0**-53)
            gaps[:, 0] += time
            times = np.cumsum(gaps, axis=1)
            near = times <= last[:, None]
            where = ragged.mix(state[near] ^ np.uint64(0x5851F42D4C957F2D))
            of = np.repeat(np.arange(len(time)), near.sum(axis=1)) if some > 1 else np.flatnonzero(near[:, 0])
            register = first[of] + (((where & low32) * np.uint64(registers)) >> np.uint64(32)).astype(np.int64)
            at = times[near] / (length * registers)
            if length > 1:
                hit = (((where >> np.uint64(32)) * np.uint64(length)) >> np.uint64(32)).astype(np.int64) < most[of]
                register, at = register[hit], at[hit]
            np.minimum.at(out.ravel(), register, at)
            on = near[:, -1]
            first, last, most, base, time = first[on], last[on], most[on], base[on], times[on, -1]
            drawn += some
        level += 1


def band_keys(times: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key for each band of each row."""
    values = np.ascontiguousarray(times).view(np.uint64).reshape(len(times), bands, -1)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), values.shape[:2])
    for k in range(values.shape[2]):
        key = ragged.mix(key * _GOLD + values[:, :, k])
    return key.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in ragged.blocks(batches, "text", BLOCK):
        row, element, weight = shingles(batch.column("text"))
        keys = band_keys(signatures(row, element, weight, batch.num_rows))
        some = np.bincount(row, minlength=batch.num_rows) > 0
        lists = pa.ListArray.from_arrays(pa.array(ragged.offsets_of(some * BANDS).astype(np.int32)), pa.array(keys[some].ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("copy"), batch.column("row"), lists], names=["doc_id", "copy", "row", "bands"])


def similarity(left: pa.Array, right: pa.Array) -> np.ndarray:
    """The weighted Jaccard similarity of the shingles of each pair of texts."""
    (own, a, n), (to, b, m) = shingles(left), shingles(right)
    return _overlap(own, a, n, to, b, m, len(left))


def _overlap(own: np.ndarray, a: np.ndarray, n: np.ndarray, to: np.ndarray, b: np.ndarray, m: np.ndarray, rows: int) -> np.ndarray:
    """The similarity of the multisets (row, element, weight) of either side, row by row."""
    _, here, there = np.intersect1d(ragged.mix(a + own.astype(np.uint64) * _GOLD), ragged.mix(b + to.astype(np.uint64) * _GOLD), assume_unique=True, return_indices=True)
    both = np.bincount(own[here], weights=np.minimum(n[here], m[there]), minlength=rows)
    total = np.bincount(own, weights=n, minlength=rows) + np.bincount(to, weights=m, minlength=rows)
    return both / np.maximum(total - both, 1)


def _verify(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, text) sorted by a, each a's own text (b null) first -> the similar (a, b)."""
    centre = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    for batch in ragged.blocks(batches, "text", BLOCK):
        row, element, weight = shingles(batch.column("text"))
        order = np.argsort(row, kind="stable")
        row, element, weight = row[order], element[order], weight[order]
        cuts = np.searchsorted(row, np.arange(batch.num_rows + 1))
        heads = np.flatnonzero(batch.column("b").is_null().to_numpy(zero_copy_only=False))
        near = np.zeros(batch.num_rows, bool)
        for start, stop in zip([-1, *heads], [*heads, batch.num_rows], strict=True):
            if start >= 0:
                own = slice(cuts[start], cuts[start + 1])
                centre = (element[own], weight[own])
            inner = slice(cuts[start + 1], cuts[stop])
            near[start + 1 : stop] = _near(centre, row[inner] - start - 1, element[inner], weight[inner], stop - start - 1) >= least
        yield batch.select(["a", "b"]).filter(pa.array(near))


def _near(centre: tuple[np.ndarray, np.ndarray], row: np.ndarray, element: np.ndarray, weight: np.ndarray, rows: int) -> np.ndarray:
    """The similarity of one multiset with each of some others."""
    names, units = centre
    order = np.argsort(names)
    names, units = names[order], units[order]
    at = np.minimum(np.searchsorted(names, element), max(0, len(names) - 1))
    shared = np.where(names[at] == element, np.minimum(weight, units[at]), 0) if len(names) else np.zeros(len(element), np.int64)
    both = np.bincount(row, weights=shared, minlength=rows)
    total = np.bincount(row, weights=weight, minlength=rows) + units.sum()
    return both / np.maximum(total - both, 1)


def _copy() -> Column:
    """The digest that stands for a text."""
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def _place() -> Column:
    """The bit of a text's first row among MARKS bitmaps."""
    return F.pmod(F.xxhash64("doc_id", "copy"), F.lit(MARKS * 32768))


def _marked(ids: DataFrame) -> DataFrame:
    """(mark, bits): MARKS bitmaps of 4 kB with a bit for the hash of each id's (doc_id, copy)."""
    place = _place()
    return ids.groupBy(F.floor(place / 32768).cast("int").alias("mark")).agg(F.bitmap_construct_agg(place % 32768).alias("bits"))


def _wanted(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of ids (id, doc_id, copy), one row each.  The bitmaps, whose size is fixed, keep most others out of the shuffle; the join decides."""
    place = _place()
    rows = texts.withColumn("mark", F.floor(place / 32768).cast("int")).join(F.broadcast(_marked(ids)), "mark")
    bit = (place % 32768).cast("int")
    byte = F.conv(F.hex(F.substring("bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    some = rows.filter(F.getbit(byte, bit % 8) == 1).groupBy("copy").agg(F.first("text").alias("text"))
    return some.join(ids, "copy").select("id", "text")


def verified(pairs: DataFrame, known: DataFrame, least: float = SIMILAR) -> DataFrame:
    """Those pairs (a, b) of ids whose texts (known: id, text) are similar.

    The text of `a` is sent once to each slice of its partners, and stays in the
    task while these pass; so a text with many partners is neither copied for
    each nor compared in one task.
    """
    slices = pairs.groupBy("a").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("n"))
    member = pairs.join(slices, "a").select("a", F.pmod(F.xxhash64("b"), F.col("n")).cast("int").alias("slice"), "b")
    centre = slices.select("a", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("slice"), F.lit(None).cast("bigint").alias("b"))
    asked = member.unionByName(centre).withColumn("id", F.coalesce("b", "a"))
    rows = asked.join(known, "id").select("a", "slice", "b", "text")
    sorted_ = rows.repartition("a", "slice").sortWithinPartitions("a", "slice", F.col("b").asc_nulls_first())
    return sorted_.select("a", "b", "text").mapInArrow(partial(_verify, least=least), "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """(id, label): every linked id and the smallest id that it is connected with.

    Each round takes the smallest label among the neighbours and then the label
    of that label, so the reach doubles; rounds are cut in the shared folder.
    """
    both = stored(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct())
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        nearer = labels.join(near, "id").select("id", F.least("label", "near").alias("to"), F.col("label").alias("old"))
        jump = labels.select(F.col("id").alias("to"), F.col("label").alias("next"))
        found = stored(nearer.join(jump, "to").select("id", F.least("to", "next").alias("label"), "old"))
        released(labels)
        labels = found
        if not found.filter("label <> old").limit(1).count():
            released(both)
            return found.select("id", "label")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The classes (id, label) after more links (a, b): what is joined are the classes, not their members."""
    for side in ("a", "b"):
        links = links.join(labels.select(F.col("id").alias(side), F.col("label").alias("to")), side, "left").withColumn(side, F.coalesce("to", side)).drop("to")
    found = components(links.filter("a <> b").distinct())
    moved = labels.join(found.select(F.col("id").alias("label"), F.col("label").alias("to")), "label", "left").select("id", F.coalesce("to", "label").alias("label"))
    return stored(moved.unionByName(found.join(labels, "id", "left_anti").select("id", "label")))


def _most_met(met: DataFrame) -> DataFrame:
    """(a, b) once for each bucket that offers it -> one pair for each b: the a offered most often, the smaller of two."""
    times = met.groupBy("a", "b").agg(F.count("*").alias("n"))
    return times.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")).select("a", "b")


def _mixed(bucket: DataFrame, labels: DataFrame) -> DataFrame:
    """The members (band, id, fame, label) of buckets with more than one class, and each bucket's largest class, `main`."""
    named = bucket.join(labels, "id", "left").select("band", "id", "fame", F.coalesce("label", "id").alias("label"))
    classes = named.groupBy("band", "label").agg(F.count("*").alias("n"))
    main = classes.groupBy("band").agg(F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("n")).filter("n > 1").select("band", F.col("top.label").alias("main"))
    return stored(named.join(main, "band"))


def _counters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of each counter's shingles among the texts of a task."""
    total = np.zeros(COUNTERS, np.int64)
    for batch in ragged.blocks(batches, "text", BLOCK):
        _, element, _ = shingles(batch.column("text"))
        total += np.bincount((element % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
    at = np.flatnonzero(total)
    for k in range(0, len(at), 1 << 16):
        part = at[k : k + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], names=["counter", "n"])


def _prefixes(batches: Iterator[pa.RecordBatch], counters, least: float) -> Iterator[pa.RecordBatch]:
    """(id, label, text) -> (id, label, size, place, shingle): the first shingles of each text, rarest first, and the units before each.

    Two multisets of n and m units that are similar share `least` times the
    larger one at least; so a text's first n - least * n + 1 units hold one of those.
    """
    common = counters.value
    for batch in ragged.blocks(batches, "text", BLOCK):
        row, element, weight = shingles(batch.column("text"))
        order = np.lexsort((element, common[(element % np.uint64(COUNTERS)).astype(np.int64)], row))
        row, element, weight = row[order], element[order], weight[order]
        size = np.bincount(row, weights=weight, minlength=batch.num_rows).astype(np.int64)
        before = np.cumsum(weight) - weight
        first = np.searchsorted(row, np.arange(batch.num_rows))
        place = before - before[first[row]] if len(row) else before
        use = place <= size[row] - np.ceil(least * size[row] - 1e-9)
        row = row[use]
        columns = [batch.column(c).take(pa.array(row)) for c in ("id", "label")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(size[row]), pa.array(place[use]), pa.array(element[use].view(np.int64))], names=["id", "label", "size", "place", "shingle"])


def rare_pairs(texts: DataFrame, least: float = SIMILAR) -> DataFrame:
    """Of (id, label, text), the pairs (a, b) of different labels that may be similar: none that is gets lost.

    A pair must share a shingle among the first of both, and after the first
    that they share each must have as many units left as the overlap needs.
    The order of the shingles only has to be the same for all; counters of fixed
    number make it nearly that of rarity.  Of each shingle's documents, those
    outside its most frequent label meet the others; those inside don't meet.
    """
    spark = texts.sparkSession
    counted = texts.select("text").mapInArrow(_counters, "counter bigint, n bigint").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    common = np.zeros(COUNTERS, np.int64)
    common[counted.column("counter").to_numpy()] = counted.column("n").to_numpy()
    counters = spark.sparkContext.broadcast(common)
    first = stored(texts.select("id", "label", "text").mapInArrow(partial(_prefixes, counters=counters, least=least), "id bigint, label bigint, size bigint, place bigint, shingle bigint"))
    labels = first.groupBy("shingle", "label").agg(F.count("*").alias("n"))
    main = labels.groupBy("shingle").agg(F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("n")).filter("n > 1").select("shingle", F.col("top.label").alias("main"))
    rows = stored(first.join(main, "shingle"))
    released(first)
    x, y = rows.filter("label <> main").alias("x"), rows.alias("y")
    col = lambda name: (F.col(f"x.{name}"), F.col(f"y.{name}"))
    (n, m), (i, j) = col("size"), col("place")
    need = F.ceil(F.lit(least / (1 + least)) * (n + m) - F.lit(1e-9))
    alike = (F.least(n, m) >= F.lit(least) * F.greatest(n, m)) & (F.least(n - i, m - j) >= need)
    once = (F.col("y.label") == F.col("y.main")) | (F.col("x.id") < F.col("y.id"))
    met = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.label") != F.col("y.label")) & once & alike)
    return met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def linked(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """From (id, doc_id, copy, bands) and (doc_id, copy, text): the classes (id, label) that the similar pairs make."""
    member = nodes.select("id", F.explode("bands").alias("band"))
    shared = member.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    met_in = stored(member.join(shared, "band"))
    # the text that most others resemble, as it lies in the fullest buckets, is the one to compare with
    fame = met_in.groupBy("id").agg(F.sum("n").alias("fame"))
    bucket = stored(met_in.select("band", "id").join(fame, "id"))
    released(met_in)
    centre = F.max_by("id", F.struct("fame", -F.col("id"))).alias("a")
    asked = stored(nodes.select("id", "doc_id", "copy").join(bucket.select("id").distinct(), "id", "left_semi"))
    known = stored(_wanted(texts, asked))
    first = bucket.groupBy("band").agg(centre)
    star = stored(_most_met(bucket.join(first, "band").filter("id <> a").select("a", F.col("id").alias("b"))))
    labels = components(stored(verified(star, known)))
    mixed = _mixed(bucket, labels)
    one = mixed.filter("label = main").groupBy("band").agg(centre)
    met = mixed.filter("label <> main").join(one, "band").select("a", F.col("id").alias("b"))
    labels = merged(labels, stored(verified(stored(_most_met(met.join(star, ["a", "b"], "left_anti"))), known)))
    released(mixed)
    mixed = _mixed(bucket, labels)
    rest = mixed.select("id", "label").distinct()
    pairs = stored(rare_pairs(stored(known.join(rest, "id"))))
    return merged(labels, stored(verified(pairs, known)))


def _classes(docs: DataFrame) -> DataFrame:
    """A row for each of `docs`: doc_id, copy, main (doc_id, copy of the row that its class keeps), kept."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _copy().alias("copy"), F.coalesce("text", F.lit("")).alias("text"))
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    signed = stored(numbered.mapInArrow(_sign, "doc_id bigint, copy binary, row bigint, bands array<bigint>"))
    # the nodes are the distinct texts, numbered as they are stored; doc_id comes back in the names of the classes
    first = signed.groupBy("copy").agg(F.min(F.struct("doc_id", "row", "bands")).alias("x")).select("copy", "x.*")
    first = stored(first.withColumn("id", F.monotonically_increasing_id()))
    labels = linked(first.select("id", "doc_id", "copy", "bands"), rows)
    one = first.select("id", "copy", F.struct("doc_id", "copy", "row").alias("own"))
    top = labels.join(one, "id").groupBy("label").agg(F.min("own").alias("main"))
    named = labels.join(top, "label").select("id", "main")
    classes = one.join(named, "id", "left").select("copy", F.coalesce("main", "own").alias("main"))
    return signed.select("doc_id", "copy", "row").join(classes, "copy").withColumn("kept", F.col("row") == F.col("main.row"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """`doc_id`, `text` -> one row per row: doc_id, class_id, kept (one of each class), class_key (the digest of the kept text)."""
    return _classes(docs).select("doc_id", F.col("main.doc_id").alias("class_id"), "kept", F.lower(F.hex("main.copy")).alias("class_key"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents that stay, one of each class, with their own columns.

    Rows that share doc_id and text and differ elsewhere: the one with the
    smallest hash of its columns stays.
    """
    kept = _classes(docs).filter("kept").select(F.struct(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "copy").alias("of"))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.struct(F.coalesce(F.col("doc_id").cast("bigint").cast("string"), F.lit("")).alias("id"), _copy().alias("copy")).alias("of"))
    plain = [F.col(f"row.`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    # a text is in one class only, so what is left twice are rows of one doc_id and text
    stay = whole.join(kept, "of", "left_semi").groupBy("of").agg(F.min_by("row", F.xxhash64(*plain)).alias("row"))
    return stay.select(*(F.col(f"row.`{c}`") for c in docs.columns))
