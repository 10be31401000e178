"""Toxicity by a convolutional text classifier in numpy.

A word's vector is the sum of the embeddings of its hashed features: the word and
its first four to seven letters (LETTERS).  Only features that MIN_DOCS learning
texts have get an embedding; others add nothing, so that rare words are neither
learned by heart nor mistaken for known ones.  Filters of several widths run over the
words of a whole text; each filter's largest response is kept, and a logistic
layer scores these.

Every labelled row that may be learned from counts, in Spark jobs over all of them:
which features get an embedding, the letters of each language, the weights and the
cuts.  The rows are dealt by a hash of their ids over shards of about SHARD_ROWS, their
words are found and stored once, and a task goes through a shard by Adagrad; after
each of about ROUNDS rounds the shards' weights are averaged (an embedding's over
the shards that have its feature) in fixed-point sums, whose order plays no part.
A fifth is kept apart, on which the threshold of each language is calibrated, drawn
to the common one where it rests on few toxic texts: scores are shifted, language by
language, so that the best threshold lies at THRESHOLD.  The language is guessed from
the text's letters; the lang, source and doc_id columns are no inputs.

What the driver holds is bounded: a feature needs one in LEAST_SHARE learning texts, a
language one in LANGUAGE_SHARE to be guessed, and logits are counted in bins of 1/BINS.

A filter's response to a word is one table row per distinct word, so a block's
texts cost a gather and a maximum.  Scoring is narrow: no shuffle.

Defined results: a null or empty text gets the score of a text without words;
without a labelled row of each kind all scores are 0; repeated rows give repeated
results; other columns play no part; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parcelwise.llm import ragged
from parcelwise.llm.language import held_out
from parcelwise.session import released, stored

THRESHOLD = 0.3
#: First letters of a word that are a feature each; the whole word is the first.
LETTERS = (1 << 30, 4, 5, 6, 7)
#: Learning texts in which a feature must stand to get an embedding.
MIN_DOCS = 5
DIM = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
#: Features must stand in one of so many learning texts too, which bounds their number.
LEAST_SHARE = 2000
#: Languages are guessed if one of so many learning texts is in them.
LANGUAGE_SHARE = 1000
#: Texts seen in training: as many epochs as that takes, within these bounds.
VISITS, EPOCHS = 50_000, (4, 16)
#: Rows that a task learns from, one after another, between two means of the weights, and the number of means, about.
SHARD_ROWS, ROUNDS = 2500, 16
#: Bins of a logit, and steps of a sum of weights.
BINS, STEPS = 1024, float(1 << 32)
BATCH = 16
#: Bitmaps of 4 kB that mark labelled ids (4 MB in all, whatever their number).
MARKS = 1024
#: Bytes of text in a stored block of words.
BLOCK = 2 << 20
RATE = 0.05
LETTER_BINS = 512
MOST_TIMES = 6
#: Part of a text's words that a training step sees.
KEPT = 0.5
#: Toxic texts that the common cut counts for in that of a language.
SHRINK = 50


def features_of(text: ragged.Codes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hashed features of words that lie between these code points."""
    first, found = text.byte(begin), []
    for salt, most in enumerate(LETTERS):
        stop = text.byte(np.minimum(end, begin + most))
        found.append(ragged.mix(ragged.hash_ranges(text.data, first, stop - first) + np.uint64(salt)))
    return np.stack(found, axis=1)


@dataclass
class Tokens:
    """The words of a column of texts: hashed features of each distinct word, and the words of each text in order."""

    features: np.ndarray
    which: np.ndarray
    begin: np.ndarray
    letters: np.ndarray
    words: pa.Array | None = None

    @classmethod
    def of(cls, column: pa.Array, words: bool = False) -> Tokens:
        """With `words`, the distinct words too, as strings."""
        lowered = pa.array([(t or "").lower() for t in column.to_pylist()], pa.large_string())
        text = ragged.Codes(*ragged.utf8(lowered))
        kind = ragged.char_classes()[text.codes]
        begin, end = ragged.runs(text, kind, ragged.LETTER)
        first, last = text.byte(begin), text.byte(end)
        sample, which = ragged.distinct(text.data, first, last - first)
        at = np.searchsorted(begin, text.rows)
        letter = np.flatnonzero(kind == ragged.LETTER)
        row = ragged.rows_of(letter, text.rows)
        bins = np.bincount(row * LETTER_BINS + text.codes[letter] % LETTER_BINS, minlength=len(column) * LETTER_BINS)
        size = (last - first)[sample]
        own = ragged.binaries(ragged.take(text.data, first[sample], size), ragged.offsets_of(size)).cast(pa.string()) if words else None
        return cls(features_of(text, begin[sample], end[sample]), which, at, bins.reshape(-1, LETTER_BINS), own)


@dataclass
class Network:
    """`known` are the sorted features with an embedding; the table's last row is the zero vector of all others."""

    known: np.ndarray
    table: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    shift: float = 0.0
    letters: np.ndarray = field(default_factory=lambda: np.zeros((1, LETTER_BINS)))
    cut: np.ndarray = field(default_factory=lambda: np.zeros(1))

    @classmethod
    def start(cls, known: np.ndarray, seed: int = 11) -> Network:
        draw = np.random.default_rng(seed)
        table = draw.normal(0, 0.1, (len(known) + 1, DIM)).astype(np.float32)
        table[-1] = 0
        filters = [draw.normal(0, 0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        n = FILTERS * len(WIDTHS)
        return cls(known, table, filters, np.zeros(n, np.float32), draw.normal(0, 0.3, n).astype(np.float32))

    def rows(self, tokens: Tokens) -> np.ndarray:
        """The table rows of each distinct word's features."""
        at = np.minimum(np.searchsorted(self.known, tokens.features), len(self.known) - 1)
        return np.where(self.known[at] == tokens.features, at, len(self.known))

    def responses(self, tokens: Tokens) -> np.ndarray:
        """The largest response of each filter in each text; 0 at least."""
        vectors = self.table[self.rows(tokens)].sum(axis=1)
        counts = np.diff(tokens.begin)
        pad = max(WIDTHS)
        # every text ends in words without a vector
        place = np.repeat(np.arange(len(counts)) * pad, counts) + np.arange(len(tokens.which))
        index = np.full(len(tokens.which) + pad * len(counts), len(vectors), np.int64)
        index[place] = tokens.which
        head = tokens.begin[:-1] + np.arange(len(counts)) * pad
        # a window begins at a word or just behind the last: one that began later would reach into the next text
        spans = np.stack([head, head + counts + 1], axis=1).ravel()
        pooled = []
        for weights, bias in zip(self.filters, np.split(self.bias, len(WIDTHS)), strict=True):
            total = None
            for j, part in enumerate(weights):
                rows = np.concatenate([vectors @ part, np.zeros((1, FILTERS), np.float32)])[index]
                if total is None:
                    total = rows
                else:
                    total[: len(rows) - j] += rows[j:]
            pooled.append(np.maximum.reduceat(total, spans, axis=0)[::2] + bias)
        return np.maximum(np.concatenate(pooled, axis=1), 0)

    def language(self, tokens: Tokens) -> np.ndarray:
        return (tokens.letters @ self.letters.T).argmax(axis=1)

    def logits(self, tokens: Tokens) -> np.ndarray:
        return self.responses(tokens) @ self.out + self.shift

    def scores(self, column: pa.Array) -> np.ndarray:
        tokens = Tokens.of(column)
        z = self.logits(tokens) - self.cut[self.language(tokens)] + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _first_largest(total: np.ndarray, head: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each filter's largest response in each text and where it is first."""
    most = np.maximum.reduceat(total, np.stack([head, head + windows], axis=1).ravel(), axis=0)[::2]
    text = np.repeat(np.arange(len(head)), windows)
    place = np.repeat(head - np.cumsum(windows) + windows, windows) + np.arange(windows.sum())
    at, column = np.nonzero(total[place] == most[text])
    _, first = np.unique(text[at] * FILTERS + column, return_index=True)
    return most, place[at[first]].reshape(len(head), FILTERS)


def gradients(net: Network, words: np.ndarray, counts: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[list[np.ndarray], float, np.ndarray, np.ndarray]:
    """Of the weighted log loss of a batch: for filters, bias and out, for the shift, and rows of the table with theirs.

    `words` are table rows of the texts' words, `counts` the texts' numbers of words.
    Through the maxima, only the words that give them learn.
    """
    pad, own = max(WIDTHS), np.arange(len(counts))
    head = np.cumsum(counts + pad) - counts - pad
    place = np.repeat(own * pad, counts) + np.arange(len(words))
    vectors = np.zeros((len(words) + pad * len(counts), DIM), np.float32)
    vectors[place] = net.table[words].sum(axis=1)
    word = np.full(len(vectors), -1)
    word[place] = np.arange(len(words))
    pooled, where = [], []
    for weights in net.filters:
        total = vectors @ weights[0]
        for j, part in enumerate(weights[1:], 1):
            total[:-j] += vectors[j:] @ part
        most, at = _first_largest(total, head, counts + 1)
        pooled.append(most)
        where.append(at)
    raw = np.concatenate(pooled, axis=1) + net.bias
    active = np.maximum(raw, 0)
    error = weight * (1 / (1 + np.exp(-np.clip(active @ net.out + net.shift, -30, 30))) - labels)
    inner = (error[:, None] * net.out * (raw > 0)).astype(np.float32)
    grads, rows, values = [], [], []
    for k, (weights, at) in enumerate(zip(net.filters, where, strict=True)):
        mine = inner[:, k * FILTERS : (k + 1) * FILTERS]
        grads.append(np.stack([np.einsum("bfd,bf->df", vectors[at + j], mine) for j in range(len(weights))]))
        for j, part in enumerate(weights):
            found = word[at + j]
            real = (found >= 0) & (mine != 0)
            rows.append(words[found[real]])
            values.append((mine[:, :, None] * part.T)[real])
    grads += [inner.sum(axis=0), error @ active]
    rows, values = np.concatenate(rows), np.repeat(np.concatenate(values), len(LETTERS), axis=0)
    real = rows.ravel() < len(net.known)
    names, inverse = np.unique(rows.ravel()[real], return_inverse=True)
    sums = np.zeros((len(names), DIM), np.float32)
    np.add.at(sums, inverse, values[real])
    return grads, float(error.sum()), names, sums


def _step(net: Network, memory: list[np.ndarray], words: np.ndarray, counts: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> None:
    """One batch by Adagrad."""
    grads, shift, names, sums = gradients(net, words, counts, labels, weight)
    for x, g, m in zip((*net.filters, net.bias, net.out), grads, memory[1:], strict=True):
        m += g * g
        x -= RATE * g / np.sqrt(m + 1e-8)
    net.shift -= RATE * shift / len(labels)
    memory[0][names] += sums * sums
    net.table[names] -= RATE * sums / np.sqrt(memory[0][names] + 1e-8)


def best_cut(z: np.ndarray, labels: np.ndarray, seen: np.ndarray | None = None) -> float:
    """Between the logits where the F1 of calling everything above toxic is best, in the middle of the gap.

    With `seen`, z are bins of so many texts, of which `labels` are toxic.
    """
    order = np.argsort(-z, kind="stable")
    seen = np.ones(len(z)) if seen is None else seen[order]
    z, labels = z[order], labels[order]
    hits = np.cumsum(labels)
    f1 = 2 * hits / (np.cumsum(seen) + labels.sum())
    last = np.append(z[1:] < z[:-1], True)
    k = int(np.argmax(np.where(last, f1, -1)))
    return float((z[k] + z[k + 1]) / 2 if k + 1 < len(z) else z[k] - 1)


def shrunk_cut(z: np.ndarray, labels: np.ndarray, common: float, seen: np.ndarray | None = None) -> float:
    """A language's own best cut, drawn to the common one as if that rested on SHRINK toxic texts more."""
    n = float(labels.sum())
    return (n * best_cut(z, labels, seen) + SHRINK * common) / (n + SHRINK) if n else common


_BLOCK = "part int, shard int, words array<string>, which binary, counts binary, toxic binary, langs array<string>, letter_at binary, letter_n binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of a shard's texts, a block to a row: distinct ones, which of them each text has in order, and its letters but for zeros."""
    names = [x.split(" ")[0] for x in _BLOCK.split(", ")]
    types = [pa.int32()] * 2 + [pa.list_(pa.string())] + [pa.binary()] * 3 + [pa.list_(pa.string())] + [pa.binary()] * 2
    for batch in batches:
        for block in (b for s in _shards(batch) for b in ragged.blocks(iter([s]), "text", BLOCK)):
            tokens = Tokens.of(block.column("text"), words=True)
            letters = tokens.letters.ravel()
            at = np.flatnonzero(letters)
            small = np.uint16 if len(tokens.words) < 1 << 16 else np.int32
            arrays = tokens.which.astype(small), np.diff(tokens.begin).astype(np.int32), block.column("toxic").to_numpy().astype(np.int8), at.astype(np.int32), letters[at].astype(np.int32)
            which, counts, toxic, letter_at, letter_n = (x.tobytes() for x in arrays)
            row = [*(block.column(c)[0].as_py() for c in ("part", "shard")), tokens.words, which, counts, toxic, block.column("lang").to_pylist(), letter_at, letter_n]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=names)


def _shards(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A sorted batch, cut where the part or the shard changes."""
    key = np.stack([batch.column(c).to_numpy() for c in ("part", "shard")])
    cuts = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [batch.num_rows]])
    for at, to in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if to > at:
            yield batch.slice(at, to - at)


def _tokens(row: dict) -> Tokens:
    """A stored block's words; letters only if they were read."""
    counts = np.frombuffer(row["counts"], np.int32)
    letters = np.zeros((len(counts), LETTER_BINS), np.int64)
    if "letter_at" in row:
        letters.ravel()[np.frombuffer(row["letter_at"], np.int32)] = np.frombuffer(row["letter_n"], np.int32)
    begin = np.cumsum([0, *counts])
    which = np.frombuffer(row["which"], np.uint16 if len(row["which"]) == 2 * begin[-1] else np.int32).astype(np.int64)
    text = ragged.Codes(*ragged.utf8(row["words"]))
    return Tokens(features_of(text, text.rows[:-1], text.rows[1:]), which, begin, letters)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Stored blocks one by one, their words as an Arrow array."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield {c: batch.column(c)[k].values if c == "words" else batch.column(c)[k].as_py() for c in batch.schema.names}


_COUNTS = "kind string, lang string, key bigint, n bigint"


def _counts(batches: Iterator[pa.RecordBatch], calibrating: int) -> Iterator[pa.RecordBatch]:
    """Of each stored block: texts with a feature, letters of a language, and rows of a language by label, and whether they calibrate."""
    for row in _rows(batches):
        tokens, toxic = _tokens(row), np.frombuffer(row["toxic"], np.int8)
        text = np.repeat(np.arange(len(toxic)), np.diff(tokens.begin))
        pairs = np.unique(text * max(1, len(tokens.features)) + tokens.which)
        text, word = pairs // max(1, len(tokens.features)), pairs % max(1, len(tokens.features))
        found, inverse = np.unique(tokens.features, return_inverse=True)
        inverse = inverse.reshape(-1, len(LETTERS))
        in_docs = np.zeros(len(found), np.int64)
        for k in range(len(LETTERS) if len(found) else 0):  # a feature is of one kind alone
            in_docs += np.bincount(np.unique(text * len(found) + inverse[word, k]) % len(found), minlength=len(found))
        out = [(["feature"] * len(found), [None] * len(found), found.view(np.int64), in_docs)]
        langs = np.array([x or "" for x in row["langs"]], object)
        null = np.array([x is None for x in row["langs"]])
        for name in sorted(set(langs.tolist())):
            own = langs == name
            label = np.bincount(toxic[own] + 2 * (row["part"] == calibrating), minlength=4)
            out.append((["rows"] * 4, [name] * 4, np.arange(4), label))
            letters = tokens.letters[own & ~null].sum(axis=0)
            at = np.flatnonzero(letters)
            out.append((["letters"] * (len(at) + 1), [name] * (len(at) + 1), np.append(at, -1), np.append(letters[at], (own & ~null).sum())))
        kind, lang, key, n = zip(*out, strict=True)
        arrays = [pa.array(sum(kind, []), pa.string()), pa.array(sum(lang, []), pa.string()), pa.array(np.concatenate(key)), pa.array(np.concatenate(n).astype(np.int64))]
        yield pa.RecordBatch.from_arrays(arrays, names=["kind", "lang", "key", "n"])


def _packed(arrays: list[np.ndarray], last: float) -> np.ndarray:
    """Weights as rows of DIM: the table's, then all others."""
    rest = np.concatenate([*(x.ravel() for x in arrays[1:]), [last]])
    return np.concatenate([arrays[0], np.pad(rest, (0, -len(rest) % DIM)).reshape(-1, DIM)]).astype(float)


def _unpacked(rows: np.ndarray, like: list[np.ndarray]) -> tuple[list[np.ndarray], float]:
    table, rest = rows[: len(like[0])].astype(np.float32), rows[len(like[0]) :].ravel()
    cuts = np.cumsum([x.size for x in like[1:]])
    return [table, *(p.astype(np.float32).reshape(x.shape) for p, x in zip(np.split(rest, cuts)[:-1], like[1:], strict=True))], float(rest[cuts[-1]])


def _weights(net: Network) -> list[np.ndarray]:
    return [net.table, *net.filters, net.bias, net.out]


@dataclass
class State:
    """What a round begins with; `times` and `heavy` by language and label."""

    net: Network
    memory: list[np.ndarray]
    times: dict[str, int]
    heavy: float

    def packed(self) -> np.ndarray:
        return np.concatenate([_packed(_weights(self.net), self.net.shift), _packed(self.memory, 0.0)], axis=1)

    def after(self, rows: np.ndarray) -> State:
        (table, *rest), shift = _unpacked(rows[:, :DIM], _weights(self.net))
        memory, _ = _unpacked(rows[:, DIM:], self.memory)
        n = len(WIDTHS)
        return replace(self, net=Network(self.net.known, table, rest[:n], rest[n], rest[n + 1], shift), memory=memory)

    def learn(self, row: dict, draw: np.random.Generator) -> None:
        """A pass over a stored block, in batches; each sees a part of the words, so that no single one can stand for a whole text."""
        tokens, toxic = _tokens(row), np.frombuffer(row["toxic"], np.int8).astype(float)
        features = self.net.rows(tokens)
        times = np.array([self.times.get(x or "", 1) if t else 1 for x, t in zip(row["langs"], toxic, strict=True)])
        order = draw.permutation(np.repeat(np.arange(len(toxic)), times))
        size = np.diff(tokens.begin)
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            n = size[rows]
            place = np.repeat(tokens.begin[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())
            kept = draw.random(len(place)) < KEPT
            counts = np.bincount(np.repeat(np.arange(len(rows)), n)[kept], minlength=len(rows))
            _step(self.net, self.memory, features[tokens.which[place[kept]]], counts, toxic[rows], np.where(toxic[rows] == 1, self.heavy, 1.0))


_VALUES = [f"v{k}" for k in range(2 * DIM)]
_CHANGES = "key bigint, " + ", ".join(f"{c} bigint" for c in _VALUES)


def _changes(batches: Iterator[pa.RecordBatch], model, number: int) -> Iterator[pa.RecordBatch]:
    """What each shard's pass changes of the weights and their memory: only rows that it moves, in STEPS."""
    begin = model.value.packed()
    state: State | None = None
    shard = None

    def change() -> pa.RecordBatch:
        moved = np.rint(np.clip(state.packed() - begin, -(2.0**20), 2.0**20) * STEPS).astype(np.int64)
        keys = np.flatnonzero((moved != 0).any(axis=1))
        return pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(x) for x in moved[keys].T)], names=["key", *_VALUES])

    for row in _rows(batches):
        if state is None or shard != row["shard"]:
            if state is not None:
                yield change()
            state, shard = model.value.after(begin), row["shard"]
            draw = np.random.default_rng([5, number, shard])
        state.learn(row, draw)
    if state is not None:
        yield change()


_LOGITS = "guess int, bin bigint, seen bigint, toxic bigint"


def _logits(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """Texts and toxic ones by guessed language and bin of the logit."""
    net: Network = model.value
    for row in _rows(batches):
        tokens, toxic = _tokens(row), np.frombuffer(row["toxic"], np.int8)
        bins = np.rint(np.clip(net.logits(tokens), -1000, 1000) * BINS).astype(np.int64)
        arrays = [pa.array(net.language(tokens).astype(np.int32)), pa.array(bins), pa.array(np.ones(len(bins), np.int64)), pa.array(toxic.astype(np.int64))]
        yield pa.RecordBatch.from_arrays(arrays, names=["guess", "bin", "seen", "toxic"])


def learnable(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ids that may be learned from with their `toxic`, and `doc_id`, `text`, `lang` of each (and of some others), once.

    Of the rows of a repeated id, the one with the smallest hash of its text is taken.
    """
    known = labels.select("doc_id", "toxic").filter(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.struct(F.xxhash64("text"), F.coalesce("lang", F.lit("")))
    # bitmaps of fixed size keep most texts without a label out of the shuffle; the join decides
    place = F.pmod(F.xxhash64("doc_id"), F.lit(MARKS * 32768))
    mark, bit = F.floor(place / 32768).cast("int").alias("mark"), (place % 32768).cast("int")
    marked = known.groupBy(mark).agg(F.bitmap_construct_agg(place % 32768).alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    some = docs.filter(~held_out(F.col("doc_id"))).withColumn("mark", mark).join(F.broadcast(marked), "mark").filter(F.getbit(byte, bit % 8) == 1)
    once = some.groupBy("doc_id").agg(F.min_by(F.struct("text", "lang"), order).alias("x"))
    return known, once.select("doc_id", "x.*")


def dealt_blocks(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, int, int] | None:
    """Every labelled text that may be learned from, stored as blocks of words by part and shard, the number of parts and that of texts.

    The parts are taken in turn, one a round; the one behind the last calibrates.
    """
    known, once = learnable(docs, labels)
    size = known.join(docs.select("doc_id"), "doc_id", "left_semi").count()
    if not size:
        return None
    parts = max(1, ROUNDS // epochs(size))
    shards = -(-size // (parts * SHARD_ROWS))
    turn = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(5 * parts * shards))
    # every fifth calibrates; the others' place gives the part and the shard
    part = F.when(turn % 5 == 4, parts).otherwise(F.floor(turn / 5) % parts).cast("int")
    dealt = once.join(known, "doc_id").withColumns({"part": part, "shard": F.floor(turn / (5 * parts)).cast("int")})
    placed = dealt.repartitionById((parts + 1) * shards, F.col("part") * shards + F.col("shard")).sortWithinPartitions("part", "shard", F.xxhash64("doc_id"), "doc_id")
    return stored(placed.select("part", "shard", "text", "lang", "toxic").mapInArrow(_blocks, _BLOCK), "part", compression="zstd"), parts, size


def epochs(size: int) -> int:
    return min(max(VISITS // size, EPOCHS[0]), EPOCHS[1])


def fit(docs: DataFrame, labels: DataFrame) -> Network | None:
    """The network that all labelled texts teach that may be learned from; None without one of each kind."""
    found = dealt_blocks(docs, labels)
    if found is None:
        return None
    rows, parts, size = found
    try:
        return _fitted(rows, parts, size)
    finally:
        released(rows)


def _fitted(rows: DataFrame, parts: int, size: int) -> Network | None:
    context = rows.sparkSession.sparkContext
    least = min(max(MIN_DOCS, size // LEAST_SHARE), size)
    counted = rows.mapInArrow(partial(_counts, calibrating=parts), _COUNTS).groupBy("kind", "lang", "key").agg(F.sum("n").alias("n"))
    counts = counted.filter((F.col("kind") != "feature") | (F.col("n") >= least)).toArrow().to_pandas()
    of = {kind: own for kind, own in counts.groupby("kind")}
    by_label = of["rows"].groupby("key").n.sum().reindex(range(4), fill_value=0).to_numpy()
    toxic = int(by_label[1] + by_label[3])
    if not 0 < toxic < size or "feature" not in of:
        return None
    # toxic texts of rare languages come as often as if they were more, MOST_TIMES as often at most
    learned = of["rows"][of["rows"].key == 1].set_index("lang").n
    times = {x: min(MOST_TIMES, max(1, round(learned.max() / max(1, n)))) for x, n in learned.items()}
    net = Network.start(np.sort(of["feature"].key.to_numpy().view(np.uint64)))
    state = State(net, [np.full_like(x, 1e-4) for x in _weights(net)], times, min(5.0, np.sqrt((size - toxic) / toxic)))
    own = rows.select("part", "shard", "words", "which", "counts", "toxic", "langs")
    for number in range(epochs(size) * parts):
        model = context.broadcast(state)
        moved = own.filter(F.col("part") == number % parts).mapInArrow(partial(_changes, model=model, number=number), _CHANGES)
        means = moved.groupBy("key").agg(*((F.sum(c) / F.count("*") / STEPS).alias(c) for c in _VALUES)).toArrow()
        weights = state.packed()
        weights[means.column("key").to_numpy()] += np.stack([means.column(c).to_numpy() for c in _VALUES], axis=1)
        state = state.after(weights)
        model.destroy()
    return _calibrated(rows, parts, state.net, of["letters"], size)


def _calibrated(rows: DataFrame, parts: int, net: Network, letters: pd.DataFrame, size: int) -> Network:
    """The network with its guess of languages and their cuts; the part behind the last decides, or all if that has one kind of label alone."""
    often = letters[(letters.key == -1) & (letters.n > 0) & (letters.n * LANGUAGE_SHARE >= size)].lang
    names = sorted(often)
    if names:
        table = letters[letters.key >= 0].pivot(index="lang", columns="key", values="n").reindex(index=names, columns=range(LETTER_BINS)).fillna(0).to_numpy(float) + 0.5
        net.letters = np.log(table / table.sum(axis=1, keepdims=True))
    model = rows.sparkSession.sparkContext.broadcast(net)
    for some in (rows.filter(F.col("part") == parts), rows):
        z = some.mapInArrow(partial(_logits, model=model), _LOGITS).groupBy("guess", "bin").agg(F.sum("seen").alias("seen"), F.sum("toxic").alias("toxic")).toArrow().to_pandas().sort_values(["bin", "guess"])
        if 0 < z.toxic.sum() < z.seen.sum():
            break
    model.destroy()
    own = lambda x: (x.bin.to_numpy() / BINS, x.toxic.to_numpy(float))
    common = best_cut(*own(z), z.seen.to_numpy(float))
    net.cut = np.array([shrunk_cut(*own(z[z.guess == j]), common, z.seen[z.guess == j].to_numpy(float)) for j in range(len(net.letters))])
    return net


def sample(docs: DataFrame, labels: DataFrame, rows: int, most_bytes: int) -> pa.Table:
    """Some of the texts that `fit` learns from, to look at (it learns from all): up to `rows` of up to `most_bytes` together, in the order of a hash of their ids."""
    known, _ = learnable(docs, labels)
    place = F.xxhash64("doc_id", F.lit("toxicity"))
    picked = known.orderBy(place, "doc_id").limit(rows)
    _, once = learnable(docs.join(F.broadcast(picked.select("doc_id")), "doc_id", "left_semi"), labels)
    order = Window.orderBy(place, "doc_id")
    # the sizes first, so that no text beyond the bound leaves its task
    sizes = once.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    inside = sizes.withColumn("total", F.sum("size").over(order)).filter(F.col("total") <= most_bytes).select("doc_id")
    return once.join(F.broadcast(inside), "doc_id").join(F.broadcast(picked), "doc_id").toArrow()


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    net: Network | None = model.value
    for batch in ragged.blocks(batches, "text", 2 << 20):
        score = net.scores(batch.column("text")) if net is not None else np.zeros(batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score.astype(float))], names=["doc_id", "score"])


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`doc_id`, `text` -> doc_id, held_out, score, predicted (score of THRESHOLD or more)."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(partial(_score, model=model), "doc_id bigint, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
