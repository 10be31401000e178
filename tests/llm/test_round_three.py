"""HTML extraction, conversation repair and whitening against brute force, and on odd rows."""

import html
import random
from collections import Counter, defaultdict
from functools import cache
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pytest
from conftest import same
from pyspark.sql import functions as F

from parcelwise.llm import conversation_repair, html_text, whitening

PAGE = "page_id bigint, url string, html string, host string, text string, token int"


def web_pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "h", "t", 1) for i, u, h in rows], PAGE).repartition(3)


def site(k, body):
    """A page of a host without telling names: notice and footer are the same in all pages."""
    return f'<html><head><title>t{k}</title></head><body><div class="x1">We use small files <b>here</b>.</div><div class="x2">{body}</div><div class="x3">All rights kept.</div></body></html>'


def test_template_text_goes_and_slots_stay(spark):
    rows = [(k, f"http://One.example/{k}", site(k, f"<h2>Head {k}</h2><p>Words of page {k}.<p>More of {k} &amp; its kin.")) for k in range(6)]
    # five pages of another host are copies of one article: nothing of it is a template
    rows += [(10 + k, f"http://two.example/{k}", "<body><nav>Menu</nav><article><h1>Same</h1><p>The same text.</p></article></body>") for k in range(5)]
    # too few pages for a template
    rows += [(20, "http://three.example/a", site(0, "<p>Lone page.</p>"))]
    # copies of a page without an article: all of it would be template text
    rows += [(30 + k, "http://four.example/a", "<body><p>Only this.</p></body>") for k in range(4)]
    found = {r["page_id"]: r["text"] for r in html_text.extract(web_pages(spark, rows)).collect()}
    for k in range(6):
        assert found[k] == f"Head {k}\nWords of page {k}.\nMore of {k} & its kin."
    assert {found[10 + k] for k in range(5)} == {"Same\nThe same text."}
    assert found[20] == "We use small files here.\nLone page.\nAll rights kept."
    assert {found[30 + k] for k in range(4)} == {"Only this."}


def test_classes_are_those_of_the_vectors(spark):
    draw = random.Random(3)
    rows = []
    for k in range(30):
        body = "".join(f"<p>{draw.choice('abc')}</p>" for _ in range(draw.randint(1, 3))) + ("<i>x</i>" if k % 3 else "") + ("<ul><li>u<li>v</ul>" if k % 4 else "<div>z</div>")
        rows.append((k, f"http://a{k % 2}.example/{k}", site(k, body)))
    pages = web_pages(spark, rows).withColumn("host", F.regexp_extract("url", "//([^/]*)", 1)).select("page_id", "host", "html")
    found = defaultdict(set)
    for r in html_text.classes(pages).collect():
        found[r["host"], r["class"]].add(r["token"])
    want = set()
    for host in ("a0.example", "a1.example"):
        mine = [h for _, u, h in rows if host in u]
        counts = [Counter((t.key, t.text is None) for t in html_text.tokens(h) if html_text._statistic(t)) for h in mine]
        vectors = defaultdict(set)
        for token in set().union(*counts):
            vector = tuple(c[token] for c in counts)
            if sum(v > 0 for v in vector) >= max(3, len(mine) / 2):
                vectors[vector].add(token)
        want |= {(host, frozenset(t for t, _ in kept)) for kept in vectors.values() if any(tag for _, tag in kept)}
    assert {(host, frozenset(kept)) for (host, _), kept in found.items()} == want


def test_orders_and_gaps():
    assert html_text.order_of([(1, 0), (2, 0), (1, 3), (2, 3)]) == html_text.order_of([(1, 5), (2, 5)])
    assert html_text.order_of([(1, 0), (2, 0)]) != html_text.order_of([(2, 0), (1, 0)])
    assert html_text.order_of([(1, 0), (2, 0), (2, 1), (1, 1)]) is None
    assert html_text.order_of([(1, 0), (2, 1)]) is None
    assert html_text.order_of([(1, 0), (2, 0), (1, 0)]) is None


class Plain(HTMLParser):
    """Brute force for well-formed pages: text of articles, junk by name, one element at a time."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.out, self.run = [], [], []

    def flush(self):
        text = " ".join("".join(self.run).split())
        self.run = []
        if text:
            self.out.append(text)

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.run.append(" ")
            return
        if tag in ("p", "div", "h1", "article", "li", "ul", "aside", "section"):
            self.flush()
        self.open.append((tag, dict(attrs).get("class", "")))

    def handle_endtag(self, tag):
        if tag in ("p", "div", "h1", "article", "li", "ul", "aside", "section"):
            self.flush()
        self.open.pop()

    def handle_data(self, data):
        tags = [t for t, _ in self.open]
        if "article" in tags and not {"aside", "script", "form"} & set(tags) and not any(c in ("ad", "comments", "notice") for _, c in self.open):
            self.run.append(data)


def test_extraction_is_the_plain_one(spark):
    draw = random.Random(5)
    words = ["alpha", "b&amp;c", "d&#233;", "&lt;e&gt;", "  f\n g", "h&nbsp;i", "&quot;j", "&am", "中", "<b>k</b>l", "<i>m<b>n</b></i>", "<br>", "<!-- <p>no</p> -->"]

    def bits(depth):
        made = []
        for _ in range(draw.randint(0, 4)):
            kind = draw.choice(["p", "p", "div", "section", "ul", "ad", "aside", "comments", "script", "form", "notice"])
            text = " ".join(draw.choice(words) for _ in range(draw.randint(0, 6)))
            if kind == "ul":
                made.append(f"<ul><li>{text}</li><li>q</li></ul>")
            elif kind == "script":
                made.append("<script>var t='<p>no</p>';</script>")
            elif kind in ("ad", "comments", "notice"):
                made.append(f'<div class="{kind}"><p>{text}</p></div>')
            elif kind == "p" or depth > 2:
                made.append(f"<p>{text}</p>")
            else:
                made.append(f"<{kind}>{text}{bits(depth + 1)}</{kind}>")
        return "".join(made)

    rows = [(k, f"http://h{k % 3}.example/{k}", f"<html><body><nav><ul><li>m</li></ul></nav><article><h1>T {k}</h1>{bits(0)}</article><footer>f</footer></body></html>") for k in range(120)]
    found = {r["page_id"]: r["text"] for r in html_text.extract(web_pages(spark, rows)).collect()}
    for k, _, page in rows:
        plain = Plain()
        plain.feed(page)
        assert found[k] == "\n".join(plain.out), page


def test_odd_pages(spark):
    long = "<p>" + "word " * 100_000 + "</p>"
    cases = [
        (None, None, None, ""),
        (1, "no host", "", ""),
        (2, "http://", "just text &copy; here", "just text © here"),
        (3, "http://h/", "<p>a<p>b<div>c</p>d</div>", "a\nb\nc\nd"),
        (3, "http://h/", "<p>a<p>b<div>c</p>d</div>", "a\nb\nc\nd"),
        (4, "http://h/", "<article><p>cut <b>here &am", "cut here &am"),
        (5, "http://h/", "<script>x</scrip", ""),
        (6, "http://h/", "<p title=\"a>b\">in</p></b></p></article>", "in"),
        (7, "http://h/", long, " ".join(["word"] * 100_000)),
        (8, "http://h/", "<form><main><p>in</p><form>out</form></main></form>", "in"),
        (9, "http://h/", "<main><header><h1>Head</h1>by me</header>x<table><tr><td>1<td>2<tr><td>3</table></main>", "Head\nx\n1\n2\n3"),
        (10, "http://h/", "<div><a href=x>one</a> <a href=y>two</a></div><p>see <a href=z>this</a></p>", "see this"),
        (11, "http://h/", "<" * 500 + " a <a", "<" * 500 + " a"),
    ]
    pages = web_pages(spark, [c[:3] for c in cases])
    found = [(r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract(pages).collect()]
    assert sorted(found, key=repr) == sorted(((i, t, len(t)) for i, _, _, t in cases), key=repr)
    assert html_text.extract(pages.limit(0)).count() == 0


def test_the_whole_table_is_the_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    found = {r["page_id"]: r for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        article = r["html"].split("<article>")[1].split("</article>")[0].replace("<b>", "").replace("</b>", "").replace("<br>", " ")
        for tag in ("<h1>", "</h1>", "<p>", "</p>"):
            article = article.replace(tag, "\0")
        text = "\n".join(b for b in (" ".join(html.unescape(b).split()) for b in article.split("\0")) if b)
        assert (found[r["page_id"]]["text"], found[r["page_id"]]["url"]) == (text, r["url"])


def brute_edits(rows):
    """Cost and edits over all edit sequences, the least of each state and row."""
    m = conversation_repair

    @cache
    def go(i, s, inserted):
        out = [(0, "")] if i == len(rows) and s in (0, 3) else []
        if inserted < 3:
            c, a = go(i, m.NEXT[s], inserted + 1)
            out.append((c + 5, "I" + a))
        if i < len(rows):
            initial, fault = rows[i]
            c, a = go(i + 1, s, 0)
            out.append((c + 2, "D" + a))
            if fault not in (m.BLANK, m.DUPLICATE):
                more = 5 if fault == m.CUT else 0
                moves = [("K", 0, m.NEXT[s])] if initial == m.WANTED[s] else []
                moves += [("K", 0, 1)] if s == 0 and initial == "s" else []
                for letter, cost, to in [*moves, ("R", 1, m.NEXT[s])]:
                    c, a = go(i + 1, to, 0)
                    out.append((c + more + cost, letter + a))
        return min(out) if out else (10**9, "")

    return go(0, 0, 0)


def test_walk_is_the_least_of_all():
    draw = random.Random(1)
    m = conversation_repair
    for _ in range(1500):
        rows = [(draw.choice(["s", "u", "a", "x", ""]), draw.choice([0, 0, 0, 1, 2, 3])) for _ in range(draw.randint(0, 9))]
        cost, audit = brute_edits(tuple(rows))
        edits, state = m.walk(rows, 0, m.END, True)
        assert "".join(e[0] for e in edits) == audit
        assert state in (0, 3)
        assert m.times(m.matrix(rows), m.END)[0] == cost


TURNS = "conv_id bigint, turn bigint, role string, text string, `key` int, block int, at int"


@pytest.mark.parametrize("block_rows", [4096, 5])
def test_repair_is_the_sql(spark, duck, block_rows):
    rows = [(None, None, None, None), (None, 1, "user", "a."), (1, None, "user", "x."), (1, 3, "", "y"), (1, 3, "assistant", "y!"), (2, 1, "system", " \t\x0b")]
    rows += [(3, i % 50, ["user", "assistant", "tool", "system"][i % 4], ["a.", "b", "", "c?"][i % 3]) for i in range(120)]
    rows += [(4, 0, "user", "hi.")] * 40 + [(5, 7, "user", "z" * 200_000 + ". "), (6, 2**60, "user", "é!"), (6, -5, "assistant", "ok")]
    # conversations that lose all their rows
    draw = lambda c, t: __import__("zlib").crc32(f"{c}:{t}".encode()) % 20
    rows += [(c, 0, "user", "gone.") for c in range(100, 200) if draw(c, 0) == 0]
    turns = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], TURNS).repartition(3)
    found = conversation_repair.repair(conversation_repair.damaged(turns), block_rows).toPandas()
    frame = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    con = duck.cursor()
    con.register("given_turns", frame)
    same(found, con.execute(conversation_repair.ORACLE.replace("from conversations", "from given_turns")).df())


def test_repair_of_an_empty_table(spark):
    turns = spark.createDataFrame([], TURNS)
    assert conversation_repair.repair(conversation_repair.damaged(turns)).count() == 0


def whitened_by_brute_force(x):
    """Distinct rows, numpy's eigenvectors."""
    u = np.unique(x, axis=0)
    values, vectors = np.linalg.eigh(np.cov(u.T, bias=True))
    keep = [i for i in np.argsort(-values) if values[i] > 1e-9 * values.max()][:16]
    return len(u), u.sum(0), (x - u.mean(0)) @ vectors[:, keep] / np.sqrt(values[keep]), values[keep] / values.sum()


VECTORS = "vec_id bigint, embedding array<float>, label int, x int, n int, component int"


def test_whitening_is_numpys(spark):
    made = np.random.default_rng(2)
    e = (made.normal(size=(300, 24)) @ made.normal(size=(24, 24))).astype(np.float32)
    e[:, 5] = e[:, 4]
    e[:, 6] = 0.5
    rows = [(i, v.tolist(), 0, 1, 2, 3) for i, v in enumerate(e)] + [(i, e[7].tolist(), 0, 1, 2, 3) for i in range(1000, 1150)]
    odd = [(2000, None), (2001, [float("nan")] * 24), (2002, [None] * 24), (2003, [float("inf")] + [0.0] * 23), (2004, []), (2005, [1.0] * 7)]
    df = spark.createDataFrame(rows + [(i, v, 0, 1, 2, 3) for i, v in odd], VECTORS).repartition(5)
    found = whitening.whiten(df).toPandas().sort_values(["vec_id", "component"])
    x = np.floor(64 * np.array([r[1] for r in rows], float)).astype(np.int64) + 1_000_000
    n, sums, z, explained = whitened_by_brute_force(x)
    order = np.argsort([r[0] for r in rows])
    assert len(found) == len(rows) * 16 and set(found["n"]) == {n}
    assert (found["deviation"].to_numpy()[::16] == ((n * x - sums) ** 2).sum(1)[order]).all()
    got = found["whitened"].to_numpy().reshape(-1, 16)
    signs = np.sign((got * z[order]).sum(0))
    assert np.abs(got * signs - z[order]).max() < 1e-8
    assert found["explained"].to_numpy()[:16] == pytest.approx(explained, rel=1e-9)
    assert found["identity_error"].max() < 1e-9


def test_jacobi_keeps_small_eigenvalues():
    made = np.random.default_rng(4)
    q, _ = np.linalg.qr(made.normal(size=(13, 13)))
    values = 10.0 ** -np.arange(13)
    norms, units = whitening.one_sided_jacobi(whitening.pivoted_cholesky((q * values) @ q.T))
    assert norms[:9] == pytest.approx(values[:9], rel=1e-5)
    assert np.abs(units @ units.T - np.eye(len(units))).max() < 1e-12
    d = np.diag([1e8, 1.0, 1e-8, 1e-12])
    norms, _ = whitening.one_sided_jacobi(whitening.pivoted_cholesky(d[:2, :2]))
    assert norms == pytest.approx([1e8, 1.0], rel=1e-12)


def test_whitening_of_few_rows(spark):
    df = spark.createDataFrame([(1, [0.5, 0.25], 0, 1, 2, 3), (2, [0.5, 0.25], 0, 1, 2, 3)], VECTORS)
    assert whitening.whiten(df).count() == 0
    assert whitening.whiten(df.limit(0)).count() == 0
    two = df.union(spark.createDataFrame([(None, [1.5, 0.25], 0, 1, 2, 3)], VECTORS))
    rows = whitening.whiten(two).collect()
    assert {(r["vec_id"], r["component"], r["n"], r["deviation"], round(r["whitened"], 9), round(r["explained"], 9)) for r in rows} == {
        (1, 1, 2, 64**2, -1.0, 1.0), (2, 1, 2, 64**2, -1.0, 1.0), (None, 1, 2, 64**2, 1.0, 1.0),
    }
    # seven vectors at the limit: the sums are beyond a long, the deviations too
    huge = spark.createDataFrame([(k, [3e38, float(k)], 0, 1, 2, 3) for k in range(7)] + [(9, [0.0, 3.0], 0, 1, 2, 3)], VECTORS)
    rows = whitening.whiten(huge).collect()
    assert {(r["n"], r["deviation"]) for r in rows} == {(8, None)} and len(rows) == 8
    assert sum(r["whitened"] for r in rows if r["component"] == 1) == pytest.approx(0, abs=1e-6)


def test_exact_deviations():
    x = np.array([[3, 2**40], [-5, -(2**40)], [2**61, 7]])
    n, sums = 3, np.array([int(v) for v in x.astype(object).sum(0)], object)
    true = [sum((int(v) * n - int(s)) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    assert whitening.deviations(x, n, sums) == [t if t < 2**63 else None for t in true]
    x = np.array([[3, 2**28], [-5, -(2**28)]])
    assert whitening.deviations(x, 2, x.sum(0)) == [8**2 + (2**29) ** 2] * 2


def test_a_languages_cut_is_drawn_to_the_common_one():
    import numpy as np

    from parcelwise.llm import toxicity

    z, labels = np.array([9.0, 7.0, 1.0, 0.0]), np.array([1.0, 1.0, 0.0, 0.0])
    assert toxicity.best_cut(z, labels) == 4.0
    assert toxicity.shrunk_cut(z, labels, 1.0) == (2 * 4.0 + toxicity.SHRINK) / (2 + toxicity.SHRINK)
    assert toxicity.shrunk_cut(z, np.zeros(4), 1.0) == 1.0  # no toxic text of its own
    assert toxicity.shrunk_cut(np.zeros(0), np.zeros(0), 1.0) == 1.0
