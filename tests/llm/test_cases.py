"""Planted cases: hot groups, clashing columns, nulls and repeats at stage level, and models against brute force."""

import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parcelwise.llm import language, merges, nearest, neardup, packing, quality, toxicity, url_filters

CLASHING = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept_id bigint, own_copy string, `of` int, `row` int, label int, size int"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), 1, "c", 2, 3, 4, 5) for i, t, lang in rows], CLASHING).repartition(3)


def prose(draw, n, words):
    return " ".join(draw.choice(words) for _ in range(n)) + "."


def test_pipeline_stages_on_odd_rows(spark):
    import corpus_pipeline

    draw = random.Random(8)
    words = [f"{a}{b}" for a in ("ba", "lo", "mi", "ke", "tu") for b in ("ra", "so", "ni", "pe", "da", "lu")]
    good = [prose(draw, 120, words) for _ in range(80)]
    rows = [(i, t, "xx") for i, t in enumerate(good)]
    rows += [(None, prose(draw, 120, words), "xx") for _ in range(3)]
    rows += [(7, prose(draw, 120, words), None), rows[3], rows[3], (200, good[5] + " tail", "xx"), (None, None, None), (201, "", "xx"), (202, "# $ % " * 90, "xx")]
    docs = clashing(spark, rows)
    unique = {t for _, t, _ in rows if t and "#" not in t and "tail" not in t}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "/nowhere")
        assert docs.columns[:3] == ["doc_id", "text", "lang"] and "kept_id" in docs.columns, name
    kept = docs.collect()
    # one row of each text, whatever its id, and one of the near copies
    assert len({r["text"] for r in kept}) == len(kept) == len(unique)
    assert {r["text"].replace(" tail", "") for r in kept} == unique
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "/nowhere")
    assert packed.filter("piece = 0").count() == len(kept)
    empty = clashing(spark, [(1, "x", "xx")]).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "/nowhere").count() == 0, name


def test_a_hot_group_keeps_all_its_links(spark):
    """Copies of a template with edits from a small pool: many alike, only some similar, and chains between them."""
    draw = random.Random(12)
    base = [f"w{draw.randint(0, 900)}" for _ in range(110)]
    edits = [(draw.randrange(110), f"x{k}") for k in range(25)]
    texts = []
    for _ in range(260):
        copy = list(base)
        for at, word in draw.sample(edits, draw.randint(0, 7)):
            copy[at] = word
        texts.append(" ".join(copy))
    bags = [Counter(tuple(t.split()[i : i + 5]) for i in range(106)) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and (bags[i] & bags[j]).total() >= 0.8 * (bags[i] | bags[j]).total():
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    docs = spark.createDataFrame([(i, t, "e") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string").repartition(5)
    found = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs).collect()}
    assert [found[i] for i in range(len(texts))] == label


def test_rare_pairs_lose_none(spark):
    draw = random.Random(2)
    texts = []
    for _ in range(40):
        base = [draw.choice("abcdefgh") + str(draw.randint(0, 30)) for _ in range(draw.randint(5, 80))]
        texts.append(" ".join(base))
        for _ in range(3):
            copy = list(base)
            copy[draw.randrange(len(copy))] = draw.choice(["new", "a1"])
            texts.append(" ".join(copy * draw.choice([1, 1, 2])))
    rows = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string").withColumn("label", F.col("id") % 50)
    found = {(r["a"], r["b"]) for r in neardup.rare_pairs(rows).collect()}
    i, j = np.triu_indices(len(texts), 1)
    near = neardup.similarity(pa.array([texts[k] for k in i]), pa.array([texts[k] for k in j])) >= 0.8
    want = {(int(a), int(b)) for a, b in zip(i[near], j[near], strict=True) if a % 50 != b % 50}
    assert want <= found and len(want) > 20


def test_language_probabilities_are_brute_force():
    """Interpolated Kneser-Ney by dictionaries, over one language's words."""
    words = ["banana", "bandana", "ananas", "cabana", "ban", "ban"]
    model = language.learn({"xx": [" ".join(words)], "yy": ["zzz yyy"]})
    order, d = language.ORDER, language.DISCOUNT
    runs = [list("\2" * (order - 1) + w + "\3") for w in words]
    last = Counter(tuple(r[i - order + 1 : i + 1]) for r in runs for i in range(order - 1, len(r)))
    counts = {order: last}
    for n in range(order - 1, 0, -1):
        longer = {tuple(r[i - n : i + 1]) for r in runs for i in range(order - 1, len(r))}
        counts[n] = Counter(g[1:] for g in longer)

    def p(gram, n):
        if n == 0:
            return 1 / language.UNSEEN_LETTERS
        head = {g: c for g, c in counts[n].items() if g[:-1] == gram[-n:][:-1]}
        if not head:
            return p(gram, n - 1)
        total = sum(head.values())
        return max(head.get(gram[-n:], 0) - d, 0) / total + d * len(head) / total * p(gram, n - 1)

    for word in ("banana", "cab", "nab", "xyz"):
        run = tuple("\2" * (order - 1) + word + "\3")
        want = -sum(math.log(p(run[i - order + 1 : i + 1], order)) for i in range(order - 1, len(run)))
        cost, letters = model.score(pa.array([word], pa.large_string()))
        assert letters[0] == len(word) + 1 and cost[0, 0] * letters[0] == pytest.approx(want, rel=1e-9)


def test_foreign_text_is_rejected_and_known_text_kept(spark):
    draw = random.Random(4)
    sounds = {"xx": ["ba", "lo", "mi", "ke"], "yy": ["tsch", "ung", "ein", "er"], "zz": ["éau", "ői", "ré", "ça"], "ww": ["abl", "rkw", "xqz", "vvp"]}
    make = lambda lang, n: " ".join("".join(draw.choice(sounds[lang]) for _ in range(draw.randint(1, 4))) for _ in range(n))
    rows = [(i, make(lang, 40), lang) for i, lang in enumerate(["xx", "yy"] * 150)]
    rows += [(1000 + i, make(lang, 40), None) for i, lang in enumerate(["zz", "ww"] * 20)]
    found = language.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).toPandas().set_index("doc_id")
    assert not found[found.index < 1000].rejected.any() and found[found.index >= 1000].rejected.all()


def test_every_language_and_no_repeated_row_alone_is_learned(spark):
    rows = [(i, f"text {i} of language", f"l{i % 150:03}") for i in range(600)] + [(5, "the same row", "l005")] * 400
    found = language.sample(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), 20, 1 << 10)
    assert len(found) == 150 and all(len(set(x)) == len(x) for x in found.values())
    assert all(sum(map(len, x[1:])) <= 1 << 10 for x in found.values())


def test_toxicity_forward_pass_is_brute_force():
    draw = np.random.default_rng(3)
    texts = pa.array(["one two three two", "", "three", "four five one one two"])
    tokens = toxicity.Tokens.of(texts)
    net = toxicity.Network.start(np.unique(tokens.features))
    net.bias = draw.normal(size=net.bias.shape).astype(np.float32)
    got = net.responses(tokens)
    rows = net.rows(tokens)
    for t in range(4):
        words = rows[tokens.which[tokens.begin[t] : tokens.begin[t + 1]]]
        vectors = [net.table[w].sum(axis=0) for w in words] + [np.zeros(toxicity.DIM)] * 3
        want = []
        for width, weights in zip(toxicity.WIDTHS, net.filters, strict=True):
            want.append(np.max([sum(vectors[i + j] @ weights[j] for j in range(width)) for i in range(len(words) + 1)], axis=0))
        assert got[t] == pytest.approx(np.maximum(np.concatenate(want) + net.bias, 0), abs=1e-5)


def test_a_repeated_labelled_id_is_one_learning_row(spark):
    docs = spark.createDataFrame([(1, "a b c", "e")] * 50 + [(i, "long " * 1000, "e") for i in range(3, 40)], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id bigint, quality int, toxic int")
    found = toxicity.sample(docs, labels, 100, 20_000)
    assert len(set(found.column("doc_id").to_pylist())) == len(found) <= 6


def test_packing_one_row_repeated(spark):
    docs = spark.createDataFrame([(None, None)] * 1500 + [(1, "word " * 40)] * 700, "doc_id bigint, text string").repartition(6)
    rows = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), size=64).toPandas()
    assert len(rows) == 2200
    for _, own in rows.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == np.cumsum([0, *own.length[:-1]]).tolist() and own.length.sum() <= 64
    # two pieces of some 40 ids don't fit together, so each has a sequence, with pieces of one id beside it
    assert rows.sequence_id.nunique() == 700


def test_packing_plan_is_near_the_bound():
    draw = np.random.default_rng(1)
    for n in (1, 40, 2000):
        lengths = np.minimum(64, draw.geometric(0.05, n))
        counts = {int(k): int(c) for k, c in zip(*np.unique(lengths, return_counts=True), strict=True)}
        patterns = packing.plan(counts, 64)
        used = Counter()
        for pattern, times in patterns:
            assert sum(pattern) <= 64
            for x in pattern:
                used[x] += times
        assert used == counts
        assert sum(t for _, t in patterns) <= -(-int(lengths.sum()) // 64) + 1


def test_cascade_rules_are_brute_force(spark):
    texts = ["- item one\n- item two\n" * 30, "so it goes...\nand on it goes…\nplain line\n" * 20, "12 34 56 " * 30, "the " * 30 + " ".join(f"w{i}" for i in range(30)), " ".join(f"word{i}" for i in range(60))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    c = quality.measured(lambda found: F.struct(*(found[n].alias(n) for n in ("n_letter_words", "n_bullet_lines", "n_cut_lines", "n_top_word", "n_lines"))))
    got = {r["doc_id"]: tuple(r["c"]) for r in docs.select("doc_id", c.alias("c")).collect()}
    assert got == {0: (120, 60, 0, 60, 60), 1: (180, 0, 40, 40, 60), 2: (0, 0, 0, 30, 1), 3: (60, 0, 0, 30, 1), 4: (60, 0, 0, 1, 1)}
    every = {r.name for r in (*quality.BASE, *quality.RULES)}
    assert {r.name for r in quality.cascade_order(docs, (*quality.BASE, *quality.RULES))} == every


def test_url_vocabulary_and_decoding(spark):
    terms = spark.createDataFrame([("Foo", "strict"), ("bar", "soft"), ("baz", "soft"), ("", "soft")], "term string, class string")
    strict, soft = url_filters.vocabulary(terms)
    urls = ["http://a.b/foo", "http://a.b/%66OO", "http://a.b/bar-BAZ", "http://a.b/bar", "http://a.b/foot", "http://a.b/%zz%"]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string")
    found = {r["page_id"]: r["verdict"] for r in url_filters.filter_urls(rows, strict=strict, soft=soft).collect()}
    assert [found[i] for i in range(6)] == ["block", "block", "block", "allow", "allow", "allow"]
    with pytest.raises(ValueError):
        url_filters.vocabulary(terms, 2)


def test_search_verifies_a_part_and_finds_nearly_all(spark):
    draw = np.random.default_rng(6)
    vectors = draw.normal(size=(2500, 48))
    rows = spark.createDataFrame([(i, v, 0, 1) for i, v in enumerate(vectors.tolist())], "vec_id bigint, embedding array<double>, cell int, reach int")
    found = nearest.neighbours(rows, block_rows=400).toPandas()
    hits = 0
    for q in range(0, 2500, 100):
        gap = ((vectors - vectors[q]) ** 2).sum(axis=1)
        gap[q] = np.inf
        hits += len(set(found[found.query_id == q].vec_id) & set(np.argsort(gap)[:10]))
    assert hits >= 0.9 * 250
    assert found.groupby("query_id").verified.first().mean() < 0.7 * 2500


def test_long_pre_tokens_merge_alike():
    table, byte_ids, _, _ = merges.merge_file(public_tokenizers.path("byte_bpe_50k.json"))
    draw = random.Random(5)
    word = "".join(draw.choice("abcde the ing") for _ in range(300)).encode()
    symbols = np.array([byte_ids[b] for b in word])
    one, two = (merges.merge_ragged(symbols, np.array([len(symbols)]), table, long=k) for k in (96, 1000))
    assert one[0].tolist() == two[0].tolist()
