"""Toxicity is learned from every labelled row, in shards whose weights are averaged."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from parcelwise.llm import toxicity
from parcelwise.llm.language import held_out


def tables(spark, n, every=6):
    docs = spark.range(n).select(
        F.col("id").alias("doc_id"),
        F.concat_ws(" ", F.concat(F.lit("w"), F.substring(F.md5(F.col("id").cast("string")), 1, 3)), F.lit("some words here"), F.when(F.col("id") % every == 0, "moron")).alias("text"),
        F.when(F.col("id") % 2 == 0, "en").otherwise("de").alias("lang"),
    )
    labels = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % every == 0).cast("int").alias("toxic"))
    return docs, labels


def test_every_labelled_row_is_learned_from(spark):
    docs, labels = tables(spark, 9000)
    rows, parts, size = toxicity.dealt_blocks(docs.union(docs.limit(50)), labels)
    assert size == labels.filter(~held_out(F.col("doc_id"))).count() > 6000
    blocks = rows.toArrow().to_pylist()
    assert sum(len(b["toxic"]) for b in blocks) == size
    apart = sum(len(b["toxic"]) for b in blocks if b["part"] == parts)
    assert abs(apart - size / 5) < size / 20
    assert {b["part"] for b in blocks} == set(range(parts + 1)) and len({b["shard"] for b in blocks}) > 1
    counted = rows.mapInArrow(lambda b: toxicity._counts(b, parts), toxicity._COUNTS).groupBy("kind", "lang", "key").agg(F.sum("n").alias("n"))
    word = toxicity.Tokens.of(pa.array(["moron"])).features[0, 0].view(np.int64)
    toxic = labels.filter(~held_out(F.col("doc_id")) & (F.col("toxic") == 1)).count()
    assert counted.filter((F.col("kind") == "feature") & (F.col("key") == int(word))).first()["n"] == toxic
    assert counted.filter((F.col("kind") == "rows") & F.col("key").isin(1, 3)).agg(F.sum("n")).first()[0] == toxic


def test_the_weights_do_not_hang_on_the_layout(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 60)
    docs, labels = tables(spark, 300, every=2)
    one, other = (toxicity.fit(docs.repartition(n), labels.repartition(n)) for n in (2, 5))
    assert (one.known == other.known).all() and (one.table == other.table).all() and (one.cut == other.cut).all()
    assert len(one.letters) == 2
    z = one.scores(pa.array(["some words here moron", "some words here"]))
    assert z[0] >= toxicity.THRESHOLD > z[1]


def test_gradients_are_those_of_the_loss():
    draw = np.random.default_rng(4)
    tokens = toxicity.Tokens.of(pa.array(["one two three two", "", "three", "four five one one two", "unknown"]))
    net = toxicity.Network.start(np.unique(tokens.features[:-1]))
    net.table[:-1] *= 10
    net.bias = draw.normal(size=net.bias.shape).astype(np.float32)
    labels, weight = np.array([1.0, 0, 1, 0, 0]), np.array([2.0, 1, 2, 1, 1])
    words, counts = net.rows(tokens)[tokens.which], np.diff(tokens.begin)

    def loss():
        z = net.logits(tokens).astype(float)
        return float((weight * (np.logaddexp(0, z) - labels * z)).sum())

    grads, shift, names, sums = toxicity.gradients(net, words, counts, labels, weight)
    table = np.zeros_like(net.table)
    table[names] = sums
    for x, g in zip((net.table, *net.filters, net.bias, net.out), (table, *grads), strict=True):
        for at in draw.choice(x.size - (toxicity.DIM if x is net.table else 0), 12):
            old, found = x.flat[at], []
            for step in (1e-3, -1e-3):
                x.flat[at] = old + step
                found.append(loss())
            x.flat[at] = old
            assert abs((found[0] - found[1]) / 2e-3 - g.flat[at]) < 0.01 * max(1, abs(g.flat[at]))
    assert abs(shift - (weight * (1 / (1 + np.exp(-net.logits(tokens))) - labels)).sum()) < 1e-4


def test_a_cut_over_bins_is_that_over_texts():
    z, labels = np.array([3.0, 2, 2, 1, 1, 0]), np.array([1.0, 1, 0, 1, 0, 0])
    assert toxicity.best_cut(np.array([3.0, 2, 1, 0]), np.array([1.0, 1, 1, 0]), np.array([1.0, 2, 2, 1])) == toxicity.best_cut(z, labels)
