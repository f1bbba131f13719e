"""Operators 1, 3, 6 and 10, and the pipeline."""

import random
import time
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest

from gavel.llm.html import blocks, main_text, page_text
from gavel.llm.language import CHUNK, Network, chunks, fit_language, identify, probabilities
from gavel.llm.quality import FEATURES, document_statistics, fit_quality, fit_trees, keep_good, quality_scores
from gavel.llm.toxicity import fit_ordinal, fit_toxicity, toxicity

SF = "/root/testdata/sf0.01"


def _docs(spark, name="documents"):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def _held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/">Home</a></li></ul></nav><!-- x --><div class="ad">Buy</div><header>Site</header>
<article><h1>Head &amp; more</h1><p>One  <b>two<br>three</b>&nbsp;four<p>Five &lt;6&gt; &#233;<ul><li>a<li>b</ul>
<aside>side</aside><div class="share-buttons">Share</div><form><input>go</form><p hidden>no</p><table><tr><td>c1<td>c2</table></article>
<section id="comments"><p>first!</p></section><footer>&copy; x</footer>"""


def test_page_text():
    assert page_text(PAGE).split("\n") == ["Head & more", "One two three four", "Five <6> é", "a", "b", "c1", "c2"]
    assert page_text(None) == page_text("") == page_text("<nav>x</nav>") == ""
    assert page_text("plain &amp; text <b>bold") == "plain & text bold"
    assert page_text("<p>cut <a href='x") == "cut"
    assert page_text("<main><p>m</p></main><p>rest</p>") == "m"
    assert page_text("<div>" * 3000 + "deep" + "</div>" * 10) == "deep"


def test_attributes_are_read_one_by_one():
    for page in ('<body class="home"><p>x</p></body>', '<html id="top"><article class="post"><p>x</p></article>', '<main id="content" class="ad"><p>x</p></main>'):
        assert page_text(page) == "x"
    article = "<article>%s</article>"
    for part in ('<a href="/hidden-gems">x</a>', '<p data-id="ad">x</p>', '<p data-hidden="false">x</p>', '<p title="my id=form hidden">x</p>', "<p class='legal'>x</p>", '<p class="form-intro notice">x</p>', '<h2 id="search">x</h2>', "<div class='research-notice'>x</div>", "<p data-x=a/b class>x"):
        assert page_text(article % part) == "x", part
    for part in ("<p hidden>x</p>", '<div class="big ad">x</div>', "<section id=comments>x</section>", "<div role='navigation'>x</div>", '<p style="color:red; display : none">x', "<p aria-hidden=true>x</p>"):
        assert page_text(article % part) == "", part
    assert page_text("<p>teaser</p><article><p>a</p></article><article><p>b</p></article>") == "teaser\na\nb"
    assert page_text("<article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p></article>") == "so x=2 holds"


def test_deep_and_long_pages():
    for tag in ("div", "b", "x", "li"):
        began = time.time()
        own = []
        page = f"<{tag}>" * 10_000 + "deep<p>a</p>" + f"</{tag}>" * 10_000
        assert " ".join(blocks(page, hashes=own)) == "deep a" and time.time() - began < 5
    assert len(page_text("<p>word &amp; " * 100_000).split("\n")) == 100_000


def test_dirt():
    cases = {
        '<p>a<svg class="x"/>b</p><p>c</p>': "ab\nc",
        "<p>a</p><iframe src=x /><p>b</p>": "a\nb",
        "<p>a</p><button>Buy<p>b</p>": "a\nb",
        "<p>a<button>Buy</p><p>b</p>": "a\nb",
        "<p>a<select><option>x</p><p>b</p>": "a\nb",
        "<p>a<button>Buy <b>now</b></button>b</p><p>c</p>": "ab\nc",
        '<p title="oops>one</p><p>two</p>': "one\ntwo",
        "<p don't>one</p><p class='x' title='a > b'>two</p>": "one\ntwo",
        "<p>1 < 2 and <3 <b>x</b</p><p>y": "1 < 2 and <3 x\ny",
        "<p>a<p <p>b": "a\nb",
        "<body><form action=/><div><h1>Title</h1><p>all of the page</p></div><input></form></body>": "Title\nall of the page",
        "<form><p>1</p><p>2</p><p>3</p></form><form><label>Mail</label><p>Join us</p></form>": "1\n2\n3",
        "<SCRIPT>if (a<b) x('</p>')</Script ><p>a</p><style>p{}": "a",
        "<title>t</title><textarea><p>x</p></textarea><p>a</p><!-- <p>b</p>": "a",
        "<p>a</scripty><script>x</scripty>y</script>b</p>": "ab",
    }
    for page, want in cases.items():
        assert page_text(page) == want, page


def test_dirt_takes_no_more_time_than_text():
    for dirt in ("<a ", '<p title="', "<p title='x\"", "<!--", "<!", "<script", "<script>", "</", "<", "<button>", "<svg ", "<p a='", '="', "<b", "</b ", "<form>", '<a href= "', "<p><select>"):
        page, began = "<p>begin</p>" + dirt * (1_000_000 // len(dirt)), time.time()
        text = page_text(page)
        assert text.startswith("begin") and time.time() - began < (4 if dirt in ("<form>", "<p><select>", "<b", "</b ", "<a ") else 2), (dirt, time.time() - began)


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__()
        self.open = [["", []]]

    def handle_starttag(self, tag, attrs):
        self.open[-1][1].append([tag, []])
        self.open.append(self.open[-1][1][-1])

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        self.open[-1][1].append(data)


def _plain_main_text(pages):
    """Two passes over trees of pages whose elements are all closed: count subtrees of each host's different pages, then print the rest."""
    trees = []
    for _, url, page in pages:
        t = _Tree()
        t.feed(page)
        trees.append((url.split("/")[2], t.open[0]))

    def text(node, gone, key, path):
        for x in node[1]:
            if isinstance(x, str):
                yield " ".join(x.split())
            elif x[0] != "nav" and key(x, path) not in gone:
                yield from text(x, gone, key, (*path, x[0]))

    def name(x):
        return x if isinstance(x, str) else (x[0], tuple(name(y) for y in x[1] if isinstance(y, str) or y[0] != "nav"))

    def key(x, path):
        return None if x[0] in ("body", "article") else (name(x), x[0] == "p" and "article" in path)

    def subtrees(x, path):
        for y in x[1]:
            if not isinstance(y, str) and y[0] != "nav":
                if key(y, path) and any(text(y, (), key, path)):
                    yield key(y, path)
                yield from subtrees(y, (*path, y[0]))

    seen, pages_of = {}, {}
    for host, tree in trees:
        own = "\n".join(text(tree, (), key, ()))
        pages_of.setdefault(host, set()).add(own)
        for k in set(subtrees(tree, ())):
            seen.setdefault((host, k), set()).add(own)
    out = []
    for host, tree in trees:
        n = len(pages_of[host])
        gone = {k for (h, k), on in seen.items() if h == host and len(on) >= 5 and len(on) >= (n / 2 if k[1] else min(n / 5, 5 * n**0.5))}
        out.append("\n".join(text(tree, gone, key, ())))
    return out


def test_main_text_equals_two_plain_passes(spark):
    rng = random.Random(3)
    parts = [f"<div class='c{rng.random()}'>menu {i}</div>" for i in range(6)] + [f"<p>common {i}</p>" for i in range(4)] + ["<section><p>one</p><div>two</div></section>", "<nav>home</nav>"]

    def some(depth):
        out = []
        for _ in range(rng.randint(1, 4)):
            r = rng.random()
            out.append(rng.choice(parts) if r < 0.5 else f"<p>own {rng.randint(0, 400)}</p>" if r < 0.75 or not depth else f"<{(t := rng.choice(['div', 'section']))}>{some(depth - 1)}</{t}>")
        return "".join(out)

    pages = [(i, f"https://{rng.choice('abc')}.example/{i}", f"<body>{some(2)}<article>{some(2)}</article></body>") for i in range(300)]
    got = {r["page_id"]: r["text"] for r in main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    want = _plain_main_text(pages)
    assert [got[i] for i, _, _ in pages] == want
    alone = [page_text(page) for _, _, page in pages]
    assert sum(a != b for a, b in zip(alone, want, strict=True)) > 100  # templates decide


def test_template_hashes():
    own = []
    blocks("<body><div><p>a</p></div><p>b</p></body>", hashes=own)
    assert len(own) == 3
    assert blocks("<body><div><p>a</p></div><p>b</p></body>", frozenset(own[1:2])) == ["b"]


def test_templates_go(spark):
    rows = []
    for i in range(40):
        body = f"<p>text number {i} of this page</p>"
        rows.append((i, f"https://a.example/{i}", f"<body><div>Cheap offers here</div><article><h1>H{i}</h1>{body}<div>Read also</div></article></body>"))
    rows += [(100 + i, "https://b.example/x", "<body><div>Cheap offers here</div><p>copied article</p></body>") for i in range(30)]  # copies are one page
    rows += [(200, None, None), (201, "odd", "<p>x</p>"), (0, "https://a.example/0", rows[0][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'t' text", "'h' host", "1 n_chars")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in main_text(df).collect()}
    assert got[7][0] == "H7\ntext number 7 of this page" and got[7][1] == len(got[7][0])
    assert got[110][0] == "Cheap offers here\ncopied article" and got[200] == ("", 0) and got[201] == ("x", 1)
    assert main_text(df).count() == len(rows) and main_text(df.limit(0)).count() == 0


def test_gradients_of_the_network():
    rng = np.random.default_rng(0)
    net = Network.new(["a", "b"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = rng.integers(0, 256, (5, 3)), np.array([0, 1, 0])
    mask = np.ones((5, 3))
    mask[4, 1] = 0
    _, g = net.gradients(x, y, mask)
    for name in ("state_f", "out_b", "table_f", "bias"):
        v = net.p[name]
        at = np.unravel_index(int(np.abs(g[name]).argmax()), v.shape)
        old = v[at]
        v[at] = old + 1e-2
        up, _ = net.gradients(x, y, mask)
        v[at] = old - 1e-2
        down, _ = net.gradients(x, y, mask)
        v[at] = old
        assert g[name][at] == pytest.approx((up - down) / 2e-2, rel=0.05, abs=1e-4)


def test_language_held_out(spark):
    docs = _docs(spark)
    net = fit_language(docs, 400)
    got = identify(docs, net).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.95 and got.score.between(0, 1).all()
    assert all(_held(i) for i in got.doc_id)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "die Einung von"), (5, "x " * 100_000)], "doc_id long, text string").selectExpr("*", "'zz' lang", "1 score")
    rows = {r["doc_id"]: r for r in identify(odd, net).collect()}
    assert [rows[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and rows[1]["score"] == 0 and rows[4]["lang_pred"] != "und"
    assert fit_language(docs.limit(0)) is None and {r["lang_pred"] for r in identify(odd, None).collect()} == {"und"}
    assert identify(odd.limit(0), net).count() == 0


def test_forward_pass_equals_a_plain_loop():
    """One position after another, one chunk at a time, from the formulas of a gated recurrent unit."""
    net = Network.new(["a", "b", "c"], seed=8)
    rng = np.random.default_rng(2)
    x = rng.integers(0, 256, (9, 4))
    sig = lambda v: 1 / (1 + np.exp(-v))
    want = np.zeros((9, 4, 3))
    for c in range(4):
        scores = np.tile(net.p["bias"].astype(float), (9, 1))
        for d in "fb":
            table, state, out = (net.p[f"{n}_{d}"].astype(float) for n in ("table", "state", "out"))
            k = len(state)
            h = np.zeros(k)
            for t in range(9) if d == "f" else range(8, -1, -1):
                a, s = table[x[t, c]], h @ state
                z, r = sig(a[:k] + s[:k]), sig(a[k : 2 * k] + s[k : 2 * k])
                n = np.tanh(a[2 * k :] + r * s[2 * k :])
                h = z * h + (1 - z) * n
                scores[t] += h @ out
        e = np.exp(scores - scores.max(1, keepdims=True))
        want[:, c] = e / e.sum(1, keepdims=True)
    got = net.positions(x)
    assert np.allclose(got, want, atol=1e-5)


def test_drawn_chunks(spark):
    """All chunks of short texts, DRAWS of long ones from everywhere, each as it stands in the text; bounded whatever the length."""
    from gavel.llm.language import DRAWS, drawn

    texts = ["x", "é" * 100, "".join(map(chr, range(300, 300 + 64 * DRAWS // 2))), "0123456789" * 500_000]
    df = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("cast(t as binary) raw", "sha2(t, 256) digest")
    for t, row in zip(texts, df.select(drawn().alias("c")).collect(), strict=True):
        raw, got = t.encode(), [bytes(c) for c in row.c]
        every = [raw[i : i + CHUNK] for i in range(0, len(raw), CHUNK)]
        assert got == every if len(every) <= DRAWS else len(got) == DRAWS and set(got) <= set(every)


def test_pooling_is_the_mean_over_positions():
    net = Network.new(["a", "b", "c"])
    raw = b"some bytes " * 30
    every = chunks(raw)
    p = [net.positions(every[i : i + 1].T)[: min(CHUNK, len(raw) - i * CHUNK), 0] for i in range(len(every))]
    assert probabilities(net, [raw, b""])[0] == pytest.approx(np.concatenate(p).mean(0), abs=1e-5)
    assert not probabilities(net, [b""]).any()


def _plain_trees(trees, x):
    out = []
    for row in x:
        total = trees.base
        for f, a, leaf in zip(trees.feature, trees.above, trees.leaf, strict=True):
            i = 0
            while i < len(f):
                i = 2 * i + 1 + (row[f[i]] > a[i])
            total += leaf[i - len(f)]
        out.append(1 / (1 + np.exp(-total)))
    return out


def test_trees():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((600, len(FEATURES)))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    t = fit_trees(x, y, trees=30)
    assert t.score(x[:50]) == pytest.approx(_plain_trees(t, x[:50]))
    new = rng.standard_normal((400, len(FEATURES)))
    assert ((t.score(new) > 0.5) == ((new[:, 0] > 0.3) ^ (new[:, 3] > 0))).mean() > 0.9
    none = fit_trees(np.zeros((0, len(FEATURES))), np.zeros(0))
    assert none.score(x[:2]).tolist() == [0.5, 0.5]
    assert fit_trees(x, np.ones(600)).score(x).min() > 0.9


def test_first_split_is_the_best_of_all():
    """One tree of one split against every feature and every edge, one after another."""
    rng = np.random.default_rng(4)
    x, ridge, least = rng.standard_normal((300, len(FEATURES))), 2.0, 1.0
    y = (x[:, 5] + 0.7 * rng.standard_normal(300) > 0.4).astype(float)
    t = fit_trees(x, y, trees=1, depth=1, bins=16, ridge=ridge, least=least)
    p = y.mean()
    g, h = p - y, np.full(300, p * (1 - p))
    best = (0.0, None, None)
    for j in range(len(FEATURES)):
        for edge in np.unique(np.quantile(x[:, j], np.linspace(0, 1, 17)[1:-1])):
            left = x[:, j] <= edge
            sides = [(g[s].sum(), h[s].sum()) for s in (left, ~left)]
            if min(b for _, b in sides) >= least:
                gain = sum(a * a / (b + ridge) for a, b in sides) - g.sum() ** 2 / (h.sum() + ridge)
                if gain > best[0] + 1e-12:
                    best = (gain, j, edge)
    assert (t.feature[0, 0], t.above[0, 0]) == (best[1], pytest.approx(best[2]))
    left = x[:, best[1]] <= best[2]
    for side, value in ((left, t.leaf[0, 0]), (~left, t.leaf[0, 1])):
        assert value == pytest.approx(-0.15 * g[side].sum() / (h[side].sum() + ridge))


def test_ordinal_fit_against_finite_differences():
    """At the fitted weights the slope of the mean loss, measured by differences of a plain loop, is what the penalty allows; thresholds are ordered."""
    rng = np.random.default_rng(7)
    n, width, l1 = 150, 120, 2e-3  # sparse rows, as texts have them
    x = np.zeros((n, width))
    for i in range(n):
        x[i, rng.choice(width, 6, replace=False)] = 1 + rng.random(6)
    true = x[:, :20].sum(1) - x[:, 20:30].sum(1)
    grade = np.searchsorted([1.0, 2.5, 4.0], true + rng.standard_normal(n))
    row, col = np.nonzero(x)
    model = fit_ordinal(n, row, col * 10, x[row, col], grade, steps=3000, l1=l1)
    w = np.zeros(width)
    w[model.buckets // 10] = model.weights
    assert (np.diff(model.thresholds) > 0).all()

    def loss(w, t):
        total = 0.0
        for i in range(n):
            for k in range(3):
                p = 1 / (1 + np.exp(-(x[i] @ w - t[k])))
                total -= np.log(p) if grade[i] > k else np.log(1 - p)
        return total / n

    def slope(f, at, j, e=1e-5):
        up, down = at.copy(), at.copy()
        up[j] += e
        down[j] -= e
        return (f(up) - f(down)) / (2 * e)

    for j in range(width):
        d = slope(lambda v: loss(v, model.thresholds), w, j)
        assert abs(d + l1 * np.sign(w[j])) < 1e-4 if w[j] else abs(d) <= l1 + 1e-4
    for k in range(3):
        assert abs(slope(lambda v: loss(w, v), model.thresholds, k)) < 5e-3  # thresholds take shorter steps than weights
    p = model.above(n, row, col * 10, x[row, col])
    plain = [[1 / (1 + np.exp(-(sum(x[i, j] * w[j] for j in range(width)) - t))) for t in model.thresholds] for i in range(n)]
    assert p == pytest.approx(np.array(plain)) and (np.diff(p, axis=1) <= 0).all()


def test_quality_held_out(spark):
    docs, labels = _docs(spark), _docs(spark, "labels")
    model = fit_quality(docs, labels)
    got = quality_scores(docs, model).join(labels, "doc_id").filter("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.9
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "a" * 50_000), (3, "a" * 50_000)], "doc_id long, text string").selectExpr("*", "1 score", "2 stats", "3 predicted")
    rows = quality_scores(odd, model).collect()
    assert len(rows) == 4 and all(0 <= r["score"] <= 1 for r in rows)
    kept = keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == quality_scores(docs, model).filter("predicted = 1").count()
    assert keep_good(docs.limit(0), model).count() == 0
    assert document_statistics(None) == [0.0] * len(FEATURES) == document_statistics("")
    unlabelled = fit_quality(docs, labels.selectExpr("doc_id", "cast(null as int) quality"))
    assert {r["score"] for r in quality_scores(odd, unlabelled).collect()} == {0.5}


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    model = fit_toxicity(docs, labels)
    assert (np.diff(model.thresholds) > 0).all()
    got = toxicity(docs, model).join(labels.withColumnRenamed("toxic", "label"), "doc_id").toPandas()
    got = got[[_held(i) for i in got.doc_id]]
    assert got[got.label == 0].toxic.mean() < 0.01 and got[got.label == 1].toxic.mean() > 0.8
    assert got.severity.between(0, 3).all() and got[got.label == 1].severity.mean() > got[got.label == 0].severity.mean() + 0.5
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "idiot " * 20_000), (3, "!!")], "doc_id long, text string").selectExpr("*", "1 toxic", "2 bucket")
    rows = toxicity(odd, model).collect()
    assert len(rows) == 4 and {r["toxic"] for r in rows if r["doc_id"] < 3} == {0}
    none = fit_toxicity(docs, labels.limit(0))
    assert {r["severity"] for r in toxicity(odd, none).collect()} == {0.0} or max(r["severity"] for r in toxicity(odd, none).collect()) < 1e-9


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from gavel.llm.decontaminate import decontaminate
    from gavel.llm.jaccard import similar_components

    d = f"{SF}"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], d).write.parquet(str(tmp_path / str(i)))
        seen.append(spark.read.parquet(str(tmp_path / str(i))))
    assert all(s.columns == docs.columns for s in seen[:-1])
    ids = [{r["doc_id"] for r in s.select("doc_id").collect()} for s in seen]
    assert ids[0] > ids[1] > ids[2] == ids[3] and ids[3] >= ids[4] == ids[5]
    left = similar_components(seen[1]).toPandas()
    assert ids[2] == set(left.component_id)
    assert ids[4] == ids[3] - {r["doc_id"] for r in decontaminate(seen[3], spark.read.parquet(f"{d}/benchmark.parquet")).filter("contaminated").collect()}
    texts = {r["doc_id"]: r["text"] for r in seen[4].collect()}
    for r in seen[5].collect():
        assert r["round_trip"] == ("▁" not in texts[r["doc_id"]]) and r["n_tokens"] == len(r["token_ids"])


def test_stages_on_empty_tables(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_stages_on_odd_rows(spark, tmp_path):
    import corpus_pipeline
    from gavel.llm.common import clear_stored, shared_dir

    good = next(r["text"] for r in keep_good(_docs(spark).limit(200), fit_quality(_docs(spark), _docs(spark, "labels"))).filter("length(text) > 600").collect())
    other = " ".join(f"word{i}" for i in range(400))
    rows = [(1, good), (2, good), (2, good), (3, None), (4, ""), (None, other), (5, other), (6, good + " " + other), (7, "x " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' lang", "'s' source", "length(text) n_chars", "1 token", "2 comp", "3 key", "'h' hash", "4 n", "5 spans")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(i)))
        out = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert out.columns == docs.columns
        ids = sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in out.select("doc_id").collect())
        want = {1: [-1, 1, 3, 4, 5, 6, 7], 2: [-1, 1, 2, 2, 3, 4, 5, 6, 7], 3: [-1, 1, 2, 2, 3, 4, 5, 6, 7], 4: [-1, 1, 2, 2, 3, 4, 5, 6, 7]}
        if i == 0:
            scored = quality_scores(docs, fit_quality(docs, _docs(spark, "labels"))).collect()
            assert len(scored) == len(rows)
            want[0] = sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in scored if r["score"] >= 0.5)
        assert ids == want[i], name
        if i == 2:
            left = {(r["doc_id"], r["text"]) for r in out.collect()}
            assert {(1, good), (2, ""), (3, None), (4, ""), (5, other), (None, "")} <= left
    clear_stored(spark)
    import os

    assert not [x for x in os.listdir(shared_dir(spark)) if x.startswith("gavel-")]
