"""Language identification by interpolated Kneser-Ney character models.

One model per language over the letters of lower-cased words, each word with
begin and end marks.  All models share sorted arrays of n-gram hashes: for an
n-gram, each language's discounted probability, for a context, each language's
weight of the shorter context.  A text gets the language of the lowest
cross-entropy per letter.

The distinct words of a block are scored once.  Prediction is narrow: no
shuffle; the model is broadcast.  It is learned from a sample of every language
in the table, at most DOCS_PER_LANGUAGE different documents of each, as far as
they fit BYTES_PER_LANGUAGE (the first whatever its length); so its size is
bounded for each language, and grows with their number alone.

Rejection is calibrated on a fifth of the sample that the models don't see.  Of
its texts the largest excess of the cross-entropy over the language's mean is
taken twice: as it is, and in units of 1/sqrt(letters), as short texts vary more.
A text is rejected if its own excess is above MARGIN times the sum of the two,
the second for its number of letters.

Defined results: a text that is null, empty or without a letter is `und`, with
score 0, and rejected; so is every text if no row is left to learn from; ties go
to the first language by name; repeated rows give repeated results; other
columns play no part; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parcelwise.llm import ragged

DOCS_PER_LANGUAGE = 1000
BYTES_PER_LANGUAGE = 8 << 20
ORDER = 4
DISCOUNT = 0.75
#: Letters that a language may have besides those seen.
UNSEEN_LETTERS = 1000
#: Sharpness of the score: cross-entropy differences (nats a letter) to odds.
SHARPNESS = 12.0

#: How far beyond the calibration texts a text must lie to be rejected.
MARGIN = 1.5

BEGIN, END = 2, 3


def held_out(doc_id: Column) -> Column:
    """The rows never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass
class Words:
    """The distinct words (runs of letters, lower case) of a column of texts."""

    text: ragged.Codes
    begin: np.ndarray
    end: np.ndarray
    sample: np.ndarray
    which: np.ndarray
    row: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> Words:
        lowered = pa.array([(t or "").lower() for t in column.to_pylist()], pa.large_string())
        text = ragged.Codes(*ragged.utf8(lowered))
        begin, end = ragged.runs(text, ragged.char_classes()[text.codes], ragged.LETTER)
        first, last = text.byte(begin), text.byte(end)
        sample, which = ragged.distinct(text.data, first, last - first)
        return cls(text, begin[sample], end[sample], sample, which, ragged.rows_of(begin, text.rows))


def padded(words: Words, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words' letters with order - 1 begin marks and an end mark, and the lengths of these."""
    sizes = words.end - words.begin
    full = sizes + order
    out = np.full(int(full.sum()), BEGIN, np.uint64)
    at = np.cumsum(full) - full
    place = np.repeat(at + order - 1 - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    out[place] = ragged.take(words.text.codes, words.begin, sizes)
    out[at + full - 1] = END
    return out, full


def grams(letters: np.ndarray, n: int, ends: np.ndarray) -> np.ndarray:
    """The hashes of the n letters up to each of the given places."""
    value = np.full(len(ends), n, np.uint64)
    for k in range(n):
        value = value * np.uint64(0x9E3779B97F4A7C15) + letters[ends - k]
        value ^= value >> np.uint64(29)
    return ragged.mix(value)


def predicted(full: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The places of the padded letters that are predicted: all but the begin marks."""
    at = np.cumsum(full) - full
    count = full - (order - 1)
    return np.repeat(at + order - 1 - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


@dataclass
class Model:
    languages: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    uniform: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    excess: np.ndarray

    def costs(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """The cost (nats) of each distinct word under each language, and its number of predicted letters."""
        letters, full = padded(words)
        ends = predicted(full)
        p = np.broadcast_to(self.uniform, (len(ends), len(self.languages)))
        for n in range(1, ORDER + 1):
            p = _rows(*self.grams[n - 1], grams(letters, n, ends), 0.0) + _rows(*self.contexts[n - 1], grams(letters, n - 1, ends - 1), 1.0) * p
        count = full - (ORDER - 1)
        begin = np.cumsum(count) - count
        return -np.add.reduceat(np.log(p), begin, axis=0), count

    def score(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each text: the cross-entropy per letter under each language, and the number of letters."""
        words = Words.of(column)
        total, letters = np.zeros((len(column), len(self.languages))), np.zeros(len(column), np.int64)
        if len(words.which):
            costs, count = self.costs(words)
            rows, first = np.unique(words.row, return_index=True)
            total[rows] = np.add.reduceat(costs[words.which], first, axis=0)
            letters[rows] = np.add.reduceat(count[words.which], first)
        return total / np.maximum(letters, 1)[:, None], letters


def _rows(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    if not len(keys):
        return np.full((len(wanted), values.shape[1]), missing)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where((keys[at] == wanted)[:, None], values[at], missing)


def _language_counts(column: pa.Array) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[tuple[np.ndarray, np.ndarray]]]:
    """One language's Kneser-Ney terms: per order, (n-gram, (count - D) / total of its context) and (context, weight of the shorter one)."""
    words = Words.of(column)
    letters, full = padded(words)
    ends = predicted(full)
    times = np.repeat(np.bincount(words.which, minlength=len(full)), full - (ORDER - 1)).astype(float)
    terms, weights = [], []
    for n in range(1, ORDER + 1):
        gram, context = grams(letters, n, ends), grams(letters, n - 1, ends - 1)
        keys, first, inverse = np.unique(gram, return_index=True, return_inverse=True)
        if n == ORDER:
            count = np.bincount(inverse, weights=times)
        else:  # in how many different longer n-grams it stands
            longer, at = np.unique(grams(letters, n + 1, ends), return_index=True)
            count = np.bincount(inverse[at], minlength=len(keys)).astype(float)
        heads, head = np.unique(context[first], return_inverse=True)
        total, kinds = np.bincount(head, weights=count), np.bincount(head)
        terms.append((keys, np.maximum(count - DISCOUNT, 0) / total[head]))
        weights.append((heads, DISCOUNT * kinds / total))
    return terms, weights


def _joined(tables: list[tuple[np.ndarray, np.ndarray]], missing: float) -> tuple[np.ndarray, np.ndarray]:
    keys = np.unique(np.concatenate([k for k, _ in tables]))
    values = np.full((len(keys), len(tables)), missing)
    for j, (k, v) in enumerate(tables):
        values[np.searchsorted(keys, k), j] = v
    return keys, values


def learn(texts: dict[str, list[str]]) -> Model | None:
    """A model from each language's sample of texts; the last fifth of each calibrates."""
    letters = lambda column: len(Words.of(column).which) > 0
    split = {}
    for name in sorted(texts):
        cut = max(1, len(texts[name]) * 4 // 5)
        if letters(known := pa.array(texts[name][:cut], pa.large_string())):
            split[name] = (known, pa.array(texts[name][cut:] or texts[name], pa.large_string()))
    if not split:
        return None
    found = [_language_counts(known) for known, _ in split.values()]
    each = lambda part, n: [f[part][n] for f in found]
    size = len(split)
    model = Model(list(split), [_joined(each(0, n), 0.0) for n in range(ORDER)], [_joined(each(1, n), 1.0) for n in range(ORDER)], np.full(size, 1 / UNSEEN_LETTERS), np.zeros(size), np.full(size, np.inf), np.full(size, np.inf))
    for j, (_, kept) in enumerate(split.values()):
        cost, n = model.score(kept)
        cost, n = cost[n > 0, j], n[n > 0]
        if len(n):
            model.mean[j] = np.average(cost, weights=n)
            over = np.maximum(cost - model.mean[j], 0)
            model.spread[j], model.excess[j] = over.max(), (over * np.sqrt(n)).max()
    return model


def sample(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE, most_bytes: int = BYTES_PER_LANGUAGE) -> dict[str, list[str]]:
    """Of each language, up to `per_language` different documents of up to `most_bytes` together, in the order of a hash of id and text."""
    known = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    place = F.pmod(F.xxhash64("doc_id", "text", F.lit("language")), F.lit(1 << 62))
    # about twice as many as are wanted leave the scan; equal rows have one place and become one
    share = F.least(F.lit(1.0), F.lit(2.0 * per_language) / F.count("*"))
    shares = known.groupBy("lang").agg(F.floor(share * float(1 << 62)).cast("bigint").alias("share"))
    # a row for each language, far less than the model that is broadcast too; so no text is shuffled by its language
    some = known.withColumn("place", place).join(F.broadcast(shares), "lang").filter(F.col("place") <= F.col("share"))
    rows = some.groupBy("lang", "place").agg(F.first("text").alias("text"))
    order = Window.partitionBy("lang").orderBy("place")
    first = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_language)
    size = F.octet_length("text")
    kept = first.withColumn("before", F.sum(size).over(order) - size).filter((F.col("before") + size <= most_bytes) | (F.col("rank") == 1))
    found = kept.orderBy("lang", "place").select("lang", "text").toArrow()
    out: dict[str, list[str]] = {}
    for lang, text in zip(found.column("lang").to_pylist(), found.column("text").to_pylist(), strict=True):
        out.setdefault(lang, []).append(text)
    return out


def _predict(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    found: Model | None = model.value
    for batch in ragged.blocks(batches, "text", 1 << 20):
        n = batch.num_rows
        lang, score, cost_out, out = ["und"] * n, np.zeros(n), np.full(n, np.nan), np.ones(n, bool)
        if found is not None:
            cost, letters = found.score(batch.column("text"))
            best = cost.argmin(axis=1)
            low = cost[np.arange(n), best]
            odds = np.exp(-SHARPNESS * (cost - low[:, None])).sum(axis=1)
            some = letters > 0
            lang = [found.languages[b] if s else "und" for b, s in zip(best, some, strict=True)]
            score = np.where(some, 1 / odds, 0.0)
            out = ~some | (low > found.mean[best] + MARGIN * (found.spread[best] + found.excess[best] / np.sqrt(np.maximum(letters, 1))))
            cost_out = np.where(some, low, np.nan)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang), pa.array(score), pa.array(cost_out), pa.array(out)], names=["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])


def identify(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE) -> DataFrame:
    """`doc_id`, `text`, `lang` -> doc_id, held_out, lang_pred, score, cross_entropy, rejected."""
    model = docs.sparkSession.sparkContext.broadcast(learn(sample(docs, per_language)))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(partial(_predict, model=model), "doc_id bigint, lang_pred string, score double, cross_entropy double, rejected boolean")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def accepted(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE) -> DataFrame:
    """The documents whose language is not rejected, with their own columns; the verdict is made where the row is, without a join."""
    model = docs.sparkSession.sparkContext.broadcast(learn(sample(docs, per_language)))
    return docs.mapInArrow(partial(_accepted, model=model), docs.schema)


def _accepted(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        verdicts = [out.column("rejected") for out in _predict(iter([batch]), model)]
        keep = pa.concat_arrays(verdicts) if verdicts else pa.array([], pa.bool_())
        yield batch.filter(pc.invert(keep))
