"""Token counts of whole texts under a vocabulary of lower-case words with word ends.

A block's pre-tokens are held as ragged numpy arrays; in each round every
sequence applies its lowest-rank pair, all at the same time, and the symbols
that survive the last round are counted.  Equal pre-tokens of a block are merged
once.  The job is narrow: no shuffle, and a task holds one block at a time.
A pre-token of over 96 symbols, which would need as many rounds, is merged by a
heap of its pairs instead, with the same symbols as result.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows
give repeated results; other columns play no part; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.llm import ragged
from parcelwise.llm.merges import merge_file, merge_ragged

_COUNTS = "doc_id bigint, n_bytes bigint, n_tokens bigint"


#: Lower case of a sigma by itself, and of capitals that are newer than Python's tables (fixed values).
LOWER = str.maketrans({"Σ": "σ", "\ua7cb": "\u0264", "\ua7dc": "\u019b"})


def normalized(text: str) -> str:
    """Canonical composition, then the lower case of each character by itself."""
    return unicodedata.normalize("NFC", text).translate(LOWER).lower()


def word_starts(text: ragged.Codes) -> tuple[np.ndarray, np.ndarray]:
    """Code ranges of the pre-tokens: contractions, letters, single digits, other signs; no white space."""
    kind = ragged.char_classes()[text.codes]
    start = np.ones(len(kind), bool)
    start[1:] = kind[1:] != kind[:-1]
    start |= text.first | (kind == ragged.NUMBER)
    ragged.contractions(text.codes, text.first, start)
    begin = np.flatnonzero(start)
    end = np.append(begin[1:], len(kind))
    keep = kind[begin] != ragged.SPACE
    return begin[keep], end[keep]


def _count(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    table, inner, final, specials = merge_file(path)
    special = re.compile("|".join(map(re.escape, specials)))
    for batch in ragged.blocks(batches, "text"):
        column = batch.column("text")
        n_bytes = pc.fill_null(pc.binary_length(column), 0).cast(pa.int64())
        texts = [t or "" for t in column.to_pylist()]
        counts = np.array([len(special.findall(t)) if "<|" in t else 0 for t in texts], np.int64)
        column = pa.array([normalized(special.sub(" ", t) if n else t) for t, n in zip(texts, counts, strict=True)], pa.large_string())
        data, offsets = ragged.utf8(column)
        if len(data):
            text = ragged.Codes(data, offsets)
            begin, end = word_starts(text)
            begin, end = text.byte(begin), text.byte(end)
            if len(begin):
                sample, which = ragged.distinct(data, begin, end - begin)
                lengths = (end - begin)[sample]
                words = ragged.take(data, begin[sample], lengths)
                symbols = inner[words]
                last = np.cumsum(lengths) - 1
                symbols[last] = final[words[last]]
                _, sizes = merge_ragged(symbols, lengths, table)
                counts += np.bincount(ragged.rows_of(begin, offsets), weights=sizes[which], minlength=len(texts)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n_bytes, pa.array(counts)], names=["doc_id", "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """`doc_id`, `text` -> doc_id, n_bytes (UTF-8), n_tokens by the tokenizer file at `path`, over_limit."""
    columns = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
    return columns.mapInArrow(partial(_count, path=path), _COUNTS).withColumn("over_limit", F.col("n_tokens") > limit)
