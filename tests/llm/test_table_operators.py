import random

import numpy as np
import pytest

from pathloom.llm import html_text, mixing, reputation
from pathloom.llm.embedding_dedup import embedding_dedup

from .conftest import prose

# mixing ------------------------------------------------------------------------------------------------------------------


def test_targets():
    got = mixing.targets({"b": 100, "a": 10, None: 90}, (3, 1, 2), 1.5, 2)
    assert got["a"] == 20 and abs(sum(got.values()) - 300) < 1e-9 and got["b"] == 100 and got[None] == 180
    assert mixing.targets({}) == {}


def test_cheapest_flow_against_linear_search():
    patterns, quota = [(("a",), 6), (("a", "b"), 5), (("b",), 3)], {"a": 10, "b": 7}
    flow = mixing.cheapest_flow(patterns, quota)
    into = {s: sum(v for (_, t), v in flow.items() if t == s) for s in quota}
    assert into == {"a": 10, "b": 7}
    spent = [sum(v for (i, _), v in flow.items() if i == k) for k in range(3)]
    repeated = sum(max(0, x - t) for x, (_, t) in zip(spent, patterns, strict=True))
    assert repeated == 3 and all(x <= 2 * t for x, (_, t) in zip(spent, patterns, strict=True))  # 17 wanted, 14 there


def test_mix(spark, odd_docs, no_docs):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.choice([3, 20, 200])), rng.choice(["a", "a", "a", "b", None])) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one, two = (sorted((r.doc_id, r["size"], r.source_size, r.target, r.taken, r.source) for r in mixing.mix_sources(df.repartition(n)).collect()) for n in (1, 5))
    assert [x[:5] for x in one] == [x[:5] for x in two]
    for s in ("a", "b", None):
        own = [x for x in one if x[5] == s]
        assert abs(sum(x[4] for x in own) - own[0][3]) <= 100 and sum(x[1] for x in own) == own[0][2]
    assert all(x[4] in (0, x[1], 2 * x[1]) for x in one)
    assert len(mixing.mix_sources(odd_docs).collect()) == 11
    assert mixing.mix_sources(no_docs).count() == 0
    many = df.selectExpr("doc_id", "text", "if(doc_id % 2 = 0, array('a', 'b'), array(source)) as source")
    assert mixing.mix_sources(many).count() == 600


def test_mix_goes_on_behind_documents_that_do_not_fit(spark):
    rng = random.Random(5)
    sizes = [rng.randrange(10, 71) for _ in range(500)] + [20_000] * 3
    df = spark.createDataFrame([(i, "w " * n, "a") for i, n in enumerate(sizes)], "doc_id long, text string, source string")
    for seed in range(4):
        out = mixing.mix_sources(df, seed=seed, weights=(1,), total=0.5).collect()
        gap = sum(sizes) / 2 - sum(r.taken for r in out)
        assert all(r.taken in (0, r["size"]) for r in out)
        spare = [r["size"] for r in out if not r.taken]
        assert -min(r["size"] for r in out if r.taken) <= gap < min(spare), (seed, gap)
    copies = spark.createDataFrame([(7, "w " * 30, "a")] * 10 + [(i, "w " * i, "a") for i in range(50, 90)], "doc_id long, text string, source string")
    for seed in range(3):
        out = mixing.mix_sources(copies, seed=seed, weights=(1,), total=0.1).collect()
        assert abs(sum(r.taken for r in out) - out[0].target) < 50 and len({r.taken for r in out if r.doc_id == 7}) == 1


# reputation ----------------------------------------------------------------------------------------------------------------


def test_url_parts_and_rules(spark):
    urls = ["http://A.example.org/es/1?x#y", "https://example.org/en/12", "x://evilexample.org/es/", "ftp://b.com/fr/", "http://com?/de/", "no url", None, "http://a.com/de/x://z", "://h#f", "http://example.org/en/2"]
    out = {r.page_id: r for r in reputation.url_filter(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [(out[i].host, out[i].path) for i in range(9)] == [("a.example.org", "/es/1"), ("example.org", "/en/12"), ("evilexample.org", "/es/"), ("b.com", "/fr/"), ("com", ""), ("", ""), ("", ""), ("a.com", "/de/x://z"), ("h", "")]
    assert [out[i].rule for i in range(10)] == ["example.org/es/", "example.org/en/1", "org/", "com/fr/", None, None, None, "com/de/", None, "org/"]
    assert [out[i].verdict for i in (0, 1, 2, 3, 7, 9)] == ["block", "block", "allow", "allow", "block", "allow"]


def test_reputation_shrinks_and_blocks(spark):
    rows = [("bad.example.net", 40), ("good.example.net", 0), ("lone.other.net", 1)]
    outcomes = spark.createDataFrame([(h, i < bad) for h, bad in rows for i in range(40 if bad != 1 else 1)], "host string, bad boolean")
    pages = spark.createDataFrame([(i, f"http://{h}/") for i, (h, _) in enumerate(rows)] + [(3, "http://new.example.net/"), (4, None)], "page_id long, url string")
    out = {r.page_id: r for r in reputation.url_filter(pages, outcomes=outcomes).collect()}
    assert [out[i].verdict for i in range(5)] == ["block", "allow", "allow", "allow", "allow"]
    assert out[0].bad_rate > 0.8 > out[3].bad_rate > out[1].bad_rate
    assert reputation.url_filter(pages.limit(0)).count() == 0


# pages -----------------------------------------------------------------------------------------------------------------------


def test_extraction(spark):
    page = '<html><head><title>t</title><style>p{}</style></head><body><nav><a>menu</a></nav><div class="ad">buy</div><article><h1>A &amp; B</h1><p><b>one  two<br>three<p>four<script>var t="</p>";</script> five&am</p><section class="comments"><p>me too</p></section></article><aside>side</aside><form>f</form><footer>foot</footer></body></html>'
    plain = '<body><header>site</header><div class="cookie-notice">ok</div><ul><li>x<li>y</ul>tail<!-- c --><p hidden>no</p><table><tr><td>1<td>2</table>'
    rows = [(1, "http://a.net/1", page, 5), (1, "http://a.net/1", page, 5), (2, None, plain, 5), (3, "http://a.net/3", None, 5), (4, "u", "", None), (None, "http://a.net/4", "<p>" * 2000 + "deep", 1), (5, "http://a.net/5", "<article>" + "<p>w" * 3000, 1), (6, "http://a.net/6", "a <b", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text long")
    out = {r.page_id: r for r in html_text.extract_text(df).collect()}
    assert out[1].text == "A & B\none two three\nfour five&am" and out[2].text == "x\ny\ntail\nno\n1\n2"
    assert [out[i].text for i in (3, 4, None)] == ["", "", "deep"] and out[5].n_chars == 5999 and out[6].text == "a"
    assert html_text.extract_text(df).count() == 8 and html_text.extract_text(df.limit(0)).count() == 0


def test_names_of_layouts_are_no_furniture():
    body = "<article class='{}'><h1>A</h1><p>b</p><div class='{}'>c</div></article>"

    def text(html):
        return [t for _, t in html_text.parse(html)[0]]

    for name in ("has-sidebar", "no-comments", "home menu", "widget", "single with-comments footer"):
        assert text(f"<html class='{name}'><body class='{name}'>{body.format('post', 'x')}</body></html>") == ["A", "b", "c"]
    assert text(body.format("post has-related", "wrap no-sidebar")) == ["A", "b", "c"]
    assert text(body.format("share", "comments")) == ["A", "b"]
    assert text("<main class='search'><p>a</p><article class='comment'><p>me too</p></article></main>") == ["a"]
    assert text("<div class='layout has-sidebar'><p>a</p></div><div class='sidebar'>s</div>") == ["a"]


def test_deep_and_odd_nesting_takes_linear_time():
    import time

    start = time.time()
    for html in ("<div>" * 50_000 + "deep", "<p><table><td>" + "<div>x" * 30_000, "<article>" + "<ul><li>w" * 20_000 + "</section>" * 20_000, "<body>" * 30_000 + "t", "<p>a" * 50_000 + "</div>" * 50_000):
        blocks, children, _ = html_text.parse(html)
        assert blocks and all(len(nodes) <= html_text.DEPTH for nodes, _ in blocks)
    assert time.time() - start < 20
    assert [t for _, t in html_text.parse("<div>" * 70 + "a<p>b</p>" + "</div>" * 70 + "c")[0]] == ["a", "b", "c"]


def test_importance_against_plain_counting(spark):
    from collections import Counter, defaultdict
    from math import log

    rng = random.Random(8)
    pages = []
    for i in range(24):
        extra = "".join(f"<p class='x{rng.randrange(3)}'>{rng.choice('abc')}</p>" for _ in range(rng.randrange(3)))
        pages.append(f"<body><div class='top'><p>same</p></div><div class='mid'><p>{prose(rng, 6)}</p>{extra}</div></body>")
    parsed = [html_text.parse(p) for p in pages]
    shown, texts, on = defaultdict(Counter), defaultdict(Counter), Counter()
    for blocks, children, _ in parsed:
        for node in {n for nodes, _ in blocks for n in nodes}:
            on[node] += 1
            shown[node][" ".join(children.get(node, ()))] += 1
            texts[node].update({t for nodes, t in blocks if node in nodes})
    want = {}
    for node, m in on.items():
        if m >= html_text.LEAST_PAGES:
            presentation = -sum(n / m * log(n / m) for n in shown[node].values()) / log(m)
            content = 1 - sum(log(n) for n in texts[node].values()) / len(texts[node]) / log(m)
            share = html_text.DECAY ** len(shown[node])
            want[node] = (1 - share) * presentation + share * max(content, 0.0)
    got = {r.node: r.importance for r in html_text.style_tree(spark.createDataFrame([("h", p) for p in pages], "host string, html string")).collect()}
    assert got.keys() == want.keys() and all(abs(got[n] - want[n]) < 1e-9 for n in want)


def test_style_tree_removes_what_every_page_has(spark):
    rng = random.Random(2)
    pages = [(i, f"http://s.net/{i}", f"<body><div class='x1'><p>Same words on all pages</p></div><div class='x2'><p>{prose(rng, 20)}</p><p>{prose(rng, 9)}</p></div></body>") for i in range(30)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    plain = {r.page_id: r.text for r in html_text.extract_text(df).collect()}
    assert all("Same words" not in t and t.count("\n") == 1 for t in plain.values())
    import unittest.mock

    with unittest.mock.patch.object(html_text, "SHIPPED", -1):  # the way for many nodes
        assert {r.page_id: r.text for r in html_text.extract_text(df).collect()} == plain
    few = html_text.extract_text(df.limit(3)).collect()
    assert all("Same words" in r.text for r in few)


def test_copies_of_an_article_keep_their_text(spark):
    rng = random.Random(6)
    shell = "<body><div class='x1'><p>{}</p></div><article><h1>{}</h1><p>{}</p>{}</article></body>"
    rows, want = [], {}
    for host, articles, copies in (("one", 1, 5), ("two", 2, 50), ("five", 5, 20), ("mirror", 1, 6), ("dated", 1, 9)):
        for a in range(articles):
            head, body = prose(rng, 3), prose(rng, 30)
            for c in range(copies):
                date = f"<p class='d'>day {c}</p>" if host == "dated" else ""
                rows.append((len(rows), f"http://{host}.net/{c}", shell.format(c if host == "mirror" else "", head, body, date)))
                want[rows[-1][0]] = f"{head}\n{body}" + (f"\nday {c}" if date else "")
    for c in range(12):  # what different articles share is still furniture
        rows.append((len(rows), f"http://s.net/{c}", shell.format("", prose(rng, 3), prose(rng, 30), "<div class='z'><p>Same words in all</p></div>")))
        want[rows[-1][0]] = None
    out = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(out[i] == t for i, t in want.items() if t is not None)
    assert all("Same words" not in out[i] and out[i].count("\n") == 1 for i, t in want.items() if t is None)


# vectors -----------------------------------------------------------------------------------------------------------------------


def brute(ids, x, cosine=0.95):
    n = np.sqrt((x * x).sum(1))
    s = (x @ x.T) / n[:, None] / n[None] >= cosine
    np.fill_diagonal(s, False)
    root = list(range(len(x)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in zip(*np.nonzero(s), strict=True):
        root[find(i)] = find(j)
    least = {}
    for i in range(len(x)):
        least[find(i)] = min(ids[i], least.get(find(i), ids[i]))
    return {ids[i]: (int(s[i].sum()), least[find(i)]) for i in range(len(x))}


@pytest.mark.parametrize("seed", [1, 2])
def test_vectors_against_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    seeds = rng.normal(size=(60, 32))
    parts = [seeds, seeds[:20] + rng.normal(scale=0.15, size=(20, 32)), seeds[:1] + rng.normal(scale=0.2, size=(150, 32)), np.repeat(seeds[5:6], 40, 0), 3 * seeds[6:9]]
    x = np.concatenate(parts)
    ids = rng.permutation(len(x)).tolist()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup(df).collect()}
    assert got == brute(ids, x)  # recall 1


def test_vectors_of_several_lengths_and_sizes(spark, monkeypatch):
    """An index for each common length, rare lengths directly, components beyond what can be squared, ids that are null."""
    from pathloom.llm import embedding_dedup as E

    monkeypatch.setattr(E, "SMALL", 40)
    monkeypatch.setattr(E, "BLOCK", 64)
    rng = np.random.default_rng(7)
    by_length = {}
    for length, n in ((8, 30), (16, 120), (24, 90), (3, 5)):
        seeds = rng.normal(size=(n, length))
        by_length[length] = np.concatenate([seeds, seeds[: n // 2] * rng.choice([1e-200, 1.0, 1e250], (n // 2, 1)) * (1 + rng.normal(scale=0.1, size=(n // 2, length)))])
    rows, want = [], {}
    for x in by_length.values():
        ids = list(range(len(rows), len(rows) + len(x)))
        rows += [(i, v.tolist()) for i, v in zip(ids, x, strict=True)]
        want |= brute(ids, x / np.abs(x).max(1, keepdims=True))
    rng.shuffle(rows)
    out = embedding_dedup(spark.createDataFrame([(int(i), v) for i, v in rows], "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in out} == want
    some = [(1, [1e200, 0.0]), (2, [1.0, 0.0]), (None, [3.0, 0.0]), (None, [0.0, 1.0]), (3, [1.0, 0.0, 0.0]), (4, [1.0, 0.0, 0.0]), (5, [1e-320, 0.0])]
    out = embedding_dedup(spark.createDataFrame(some, "vec_id long, embedding array<double>")).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in out), key=str) == sorted([(1, 3, 1, True), (2, 3, 1, False), (None, 3, 1, False), (5, 3, 1, False), (None, 0, None, True), (3, 1, 3, True), (4, 1, 3, False)], key=str)


def test_recall_on_the_drivers_vectors(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    x = np.stack(docs.embedding).astype(np.float64)
    near = np.concatenate([x, x[:300] + np.random.default_rng(2).normal(scale=0.25 * np.abs(x).mean(), size=(300, x.shape[1]))]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(near)], "vec_id long, embedding array<float>")
    want = brute(list(range(len(near))), near.astype(np.float64))
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup(df).collect()}
    found, there = sum(n for n, _ in got.values()), sum(n for n, _ in want.values())
    assert there > 200 and there * 0.99 <= found <= there


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [None, 1.0]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (10, [0.0, 1.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, id long, key long")
    out = embedding_dedup(df).collect()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out}
    assert len(out) == 12 and got[1] == (3, 1, True) and got[2] == (3, 1, False) and got[None] == (3, 1, False)
    assert all(got[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10))
    assert embedding_dedup(df.limit(0)).count() == 0
