import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import embeddings, html, quality, toxicity
from tests.llm.fixtures import clashing, documents, empty, prose, rows

# --- quality ----------------------------------------------------------------


def junk(rng, n):
    return " ".join(w + rng.choice(["%%%", "###", "***"]) for w in prose(rng, n).split())


def labelled(spark, n=150, seed=3, bad=junk, column="quality", low=60):
    rng = random.Random(seed)
    data = [(k, bad(rng, rng.randrange(low, 160)) if k % 4 == 0 else prose(rng, rng.randrange(low, 160)), "en", "s", 0) for k in range(n)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    good = 1 if column == "quality" else 0
    return docs, spark.createDataFrame([(k, good if k % 4 else 1 - good) for k in range(n)], f"doc_id long, {column} int")


def test_quality_is_learned(spark):
    docs, labels = labelled(spark)
    ranking = quality.learn(docs, labels.where("doc_id % 2 = 0"))
    got = {r.doc_id: r.score for r in quality.rate(docs, ranking).collect()}
    assert all((got[k] >= quality.REJECT_BELOW) == (k % 4 != 0) for k in got)


def test_quality_edges(spark):
    docs, labels = labelled(spark, 60)
    ranking = quality.learn(docs, labels)
    scores = [r.score for r in quality.rate(clashing(spark), ranking).collect()]
    assert len(scores) == len(rows()) and all(0 <= s <= 1 for s in scores)
    assert quality.rate(empty(spark), ranking).isEmpty()
    none = quality.learn(docs, labels.where("quality = 1"))
    assert {r.score for r in quality.rate(docs, none).collect()} == {0.5}
    assert not quality.learn(empty(spark), labels).fitted


def test_ranking_orders_by_preference():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 3))
    y = (x[:, 0] - x[:, 1] > 0).astype(int)
    r = quality.fit(x, y)
    assert r.weights[0] > 0 > r.weights[1] and ((r.score(x) >= quality.REJECT_BELOW) == y).mean() > 0.95


# --- toxicity ---------------------------------------------------------------


def insulting(rng, n):
    words = prose(rng, n).split()
    for _ in range(5):
        words[rng.randrange(len(words))] = rng.choice(["zugga", "zuggo", "blorf"])
    return " ".join(words)


def test_gradients_are_right():
    net = toxicity.Network(3)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((7, 2 * toxicity.EMBED))
    idx = rng.integers(-1, 7, (4, toxicity.WIDTH))
    idx[:, 0] = 2
    target = np.array([1.0, 0, 1, 0])

    def loss():
        z = net.forward(x, idx).astype(np.float64)
        return (np.logaddexp(0, z) - target * z).sum()

    logit, saved = net.forward(x, idx, train=True)
    g, d_x = net.backward(x, idx, saved, toxicity._sigmoid(logit) - target)
    for name in ("fx", "fh", "fc", "bx", "bh", "bc", "attend", "out", "bias"):
        flat = net.p[name].reshape(-1)
        for k in rng.choice(len(flat), min(6, len(flat)), replace=False):
            keep = flat[k]
            flat[k] = keep + 1e-3
            up = loss()
            flat[k] = keep - 1e-3
            down = loss()
            flat[k] = keep
            assert abs((up - down) / 2e-3 - g[name].reshape(-1)[k]) < 5e-3, name
    keep = x[2, 3]
    x[2, 3] = keep + 1e-3
    up = loss()
    x[2, 3] = keep - 1e-3
    down = loss()
    assert abs((up - down) / 2e-3 - d_x[2, 3]) < 5e-3


def test_toxicity_is_learned(spark):
    docs, labels = labelled(spark, 320, bad=insulting, column="toxic")
    net = toxicity.learn(docs, labels.where("doc_id % 3 <> 1"))
    got = [(r.doc_id, r.score) for r in toxicity.rate(docs, net).collect() if r.doc_id % 3 == 1]
    right = np.mean([(s >= toxicity.TOXIC_FROM) == (k % 4 == 0) for k, s in got])
    assert right > 0.9


def test_toxicity_edges(spark):
    docs, labels = labelled(spark, 80, bad=insulting, column="toxic")
    net = toxicity.learn(docs, labels)
    scores = [r.score for r in toxicity.rate(clashing(spark), net).collect()]
    assert len(scores) == len(rows()) and all(0 <= s <= 1 for s in scores)
    assert toxicity.rate(empty(spark), net).isEmpty()
    assert not toxicity.learn(docs, labels.where("toxic = 0")).fitted
    assert not toxicity.learn(empty(spark), labels).fitted


def test_windows_cover_all_words():
    first = np.array([0, 0, 1, 17, 17, 60, 68])
    at, text = toxicity.windows_of(first)
    assert set(at[at >= 0].tolist()) == set(range(68)) and 0 not in text and (at[:, 0] >= 0).all()
    assert all((first[t] <= w[w >= 0]).all() and (w[w >= 0] < first[t + 1]).all() for w, t in zip(at, text))


# --- embeddings -------------------------------------------------------------


def vectors_model(data, threshold=0.95):
    good = [(k, np.array(v, np.float64)) for k, v in data if v is not None and None not in v and np.isfinite(v).all() and any(v)]
    links, parent = collections.Counter(), {k: k for k, _ in data}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(good):
        for b, y in good[:i]:
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                links[a] += 1
                links[b] += 1
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {k: (links[k], find(k), find(k) == k) for k, _ in data}


def vectors(seed=2, dims=32):
    rng = np.random.default_rng(seed)
    data = [rng.standard_normal(dims) for _ in range(120)]
    data += [data[k % 12] + 0.1 * rng.standard_normal(dims) for k in range(60)]
    data += [data[0], data[0] * 3.0, -data[0], np.zeros(dims), np.full(dims, np.inf), rng.standard_normal(5), np.append(rng.standard_normal(dims - 1), np.nan)]
    out = [(k, [float(x) for x in v]) for k, v in enumerate(data)]
    return [*out, (900, None), (901, [None] * dims), (902, [])]


@pytest.mark.parametrize("block", [1024, 7])
def test_embeddings_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    data = vectors()
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumns({"rid": F.lit(1), "key": F.lit(2)})
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()}
    assert got == vectors_model(data)


def test_embeddings_edges(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).isEmpty()
    twice = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [5.0, -1.0])], "vec_id long, embedding array<float>")
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in embeddings.near_duplicates(twice).collect()) == [("1", 1, "1"), ("1", 1, "1"), ("None", 0, "None")]


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    codes, factors = embeddings.encode(x)
    guess, sd = embeddings.estimates(codes, factors, x)
    off = (guess - x @ x.T)[~np.eye(400, dtype=bool)]
    assert abs(off.mean()) < 0.005 and (np.abs(off) < embeddings.SURE * sd.max()).all()


@pytest.mark.parametrize("dims", [1, 2, 7, 64, 300])
def test_packed_rows_keep_every_pair_that_reaches_the_threshold(dims):
    rng = np.random.default_rng(dims)
    x = rng.standard_normal((40, dims))
    x = np.concatenate([x, x + 0.3 * rng.standard_normal(x.shape), np.eye(dims)[:3]])
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = embeddings.Packed(embeddings.packed(x), dims, 0.95)
    reach = x @ x.T >= 0.95
    np.fill_diagonal(reach, False)
    found = rows.block(0, len(x))
    assert found[reach].all()
    i, j = np.triu_indices(len(x), 1)
    assert (rows.pairs(i, j) == found[i, j]).mean() > 0.999 and rows.pairs(i, j)[reach[i, j]].all()
    if dims >= 64:  # and rule out the rest but for a margin
        assert not (found & (x @ x.T < 0.92)).any()


def test_bands_reach_the_recall():
    bits, bands = embeddings.bands_for(10**6)
    p = (1 - np.arccos(0.95) / np.pi) ** bits
    assert 1 - (1 - p) ** bands >= embeddings.RECALL


# --- html -------------------------------------------------------------------

TEMPLATE = """<!DOCTYPE html><html><head><title>x</title><style>p{{}}</style><script>var a="</p>";</script></head><body>
<nav><ul><li><a href="/a">menu</a></li></ul></nav><div class="ad banner-3">buy</div><div id="c{n}" class="content post-{n}">
<h1>Title {n}</h1><p>First &amp; <b>bold</b>ly said,<br>with   many words of text that goes on &lt;for a while&gt;.<p>Second paragraph, unclosed and long enough to count as text
<div class="comments">a comment</div><form>f <input></form></div><aside>side</aside><footer>&copy; foot</footer></body></html>"""
TEXT = "Title {n} First & boldly said, with many words of text that goes on <for a while>. Second paragraph, unclosed and long enough to count as text"


def pages(spark, data):
    return spark.createDataFrame(data, "page_id long, url string, html string")


def test_html_consensus(spark):
    data = [(n, f"http://Host.example/{n}", TEMPLATE.format(n=n)) for n in range(6)]
    # A page whose own best container is a long sidebar-like block is held to the host's path.
    odd = TEMPLATE.format(n=9).replace('<div class="ad banner-3">buy</div>', "<section>" + "<p>other text goes here, at length and more of it than in the article, again and again.</p>" * 6 + "</section>")
    data += [(9, "http://host.example/9", odd)]
    got = {r.page_id: r.text for r in html.extract(pages(spark, data)).collect()}
    assert got == {n: TEXT.format(n=n) for n in [*range(6), 9]}
    assert [r.host for r in html.consensus(pages(spark, data)).collect()] == ["host.example"]


LONG = "A paragraph of the article, with enough words to count as text of its own, number {}."
SHELL = '<html><body><div class="rail"><a href="/a">Some other story</a> <a href="/b">And another one</a></div>{}</body></html>'
WHOLE = {
    "title": ('<div class="content"><h1>The title</h1><div class="entry"><p>{0}</p><p>{1}</p><p>{2}</p></div></div>', "The title {0} {1} {2}"),
    "titlebox": ('<div class="content"><div class="head"><h1>The title</h1></div><div class="entry"><p>{0}</p><p>{1}</p><p>{2}</p></div></div>', "The title {0} {1} {2}"),
    "sections": ('<div class="content"><div class="intro"><p>{0}</p></div><div class="body"><p>{1}</p></div><div class="faq"><p>{2}</p></div></div>', "{0} {1} {2}"),
    "list": ('<div class="content"><p>{0}</p><ul><li>{1}</li><li>{2}</li><li>{1}</li><li>{2}</li></ul></div>', "{0} {1} {2} {1} {2}"),
}


def test_html_whole_article_without_article_or_main(spark):
    data, want = [], {}
    for h, (name, (body, text)) in enumerate(WHOLE.items()):
        for n in range(4):
            parts = [LONG.format(10 * n + k) for k in range(3)]
            data.append((10 * h + n, f"http://{name}.example/{n}", SHELL.format(body.format(*parts))))
            want[10 * h + n] = text.format(*parts)
    # One page of many sections on a host where the others have a single one.
    narrow = '<div class="content"><div class="body"><p>{0}</p><p>{1}</p></div></div>'
    for n in range(4):
        parts = [LONG.format(100 + 10 * n + k) for k in range(3)]
        data.append((100 + n, f"http://mixed.example/{n}", SHELL.format((narrow if n else WHOLE["sections"][0]).format(*parts))))
        want[100 + n] = " ".join(parts[: 2 if n else 3])
    got = {r.page_id: r.text for r in html.extract(pages(spark, data)).collect()}
    assert {k: got[k] for k in want if got[k] != want[k]} == {}


def test_html_edges(spark):
    data = [
        (1, None, None), (2, "http://a/", ""), (3, "x", "plain text &eacute;&nbsp;here"), (4, "http://b", "<article><p>cut off in the mid"),
        (5, "http://c", "<<p>>a</b></i><div>" + "x" * 50), (6, "http://d", "<!-- only a comment"), (None, "http://e", "<p>one</p><p>two</p>"),
        (7, "http://f", "<body>" + "<div>" * 500 + "deep text stands here" + "</div>" * 500), (8, "http://g", "<script>never ends"),
    ]
    got = {r.page_id: (r.text, r.n_chars) for r in html.extract(pages(spark, data).withColumns({"text": F.lit(1), "path": F.lit(2), "host": F.lit(3)})).collect()}
    assert got[1] == ("", 0) and got[2] == ("", 0) and got[3][0] == "plain text é here" and got[4][0] == "cut off in the mid"
    assert got[6][0] == "" and got[None][0] == "one two" and got[7][0] == "deep text stands here" and got[8][0] == ""
    assert html.extract(pages(spark, [])).isEmpty()


ODD = {
    "state": '<body><div class="content has-sidebar"><p>{0}</p></div></body>',
    "post": '<body><div class="post comments-open"><p>{0}</p></div></body>',
    "form": '<body><form id="aspnetForm"><input><div><p>{0}</p></div></form></body>',
    "paragraph": '<body><article><p class="ad">Buy<p>{0}</article></body>',
    "item": '<body><article><ul><li class="ad">x<li>{0}</ul></article></body>',
    "link": '<body><div><a href="x"><p>{0}</p></a></div></body>',
    "cells": '<body><table><tr><td class="ad">buy<td><p>{0}<tr><td class="ad">more</table></body>',
    "comments": '<body><div class="post"><p>{0}</p></div><div class="post-comments"><p>{0} {0} {0}</p></div></body>',
    "side": '<body><div class="site-footer">{0}</div><div><p>{0} and</p> <p>{0} more</p></div></body>',
}


@pytest.mark.parametrize("name", sorted(ODD))
def test_html_keeps_the_article(name):
    body = " ".join(LONG.format(k) for k in range(3))
    want = f"{body} and {body} more" if name == "side" else body
    assert html.Page(ODD[name].format(body)).text(None) == want


@pytest.mark.parametrize("unit", ['<a "', '<a ="', "<!", "<div>", "<p class=ad>", "<td>", "</div>", "<a b='", "<li>x", "<b>", "x", "&amp;", "<div><p class=ad>"])
def test_html_long_pages_take_time_in_proportion(unit):
    import time

    def seconds(size):
        began = time.process_time()
        html.Page(unit * (size // len(unit))).text(None)
        return time.process_time() - began

    seconds(10_000)
    assert seconds(1 << 20) < max(2.0, 16 * seconds(1 << 17))


def generated(rng, host):
    """A page and its article, of parts in the manner of `host`."""
    shell = host % 4
    blocks, text = [], []
    for k in range(rng.randrange(3, 8)):
        words = prose(rng, rng.randrange(15, 60))
        shown = words.replace(" ", rng.choice([" ", "\n ", " <b>", " <!-- ad --> "]), 1)
        shown = shown + ("</b>" if "<b>" in shown else "")
        tag = rng.choice(["p", "p", "p", "h2", "blockquote", "div"])
        blocks.append(f"<{tag}>{shown}" + ("" if tag == "p" and rng.random() < 0.3 else f"</{tag}>"))
        text.append(words)
        noise = rng.choice(["", "", '<div class="ad">buy now</div>', '<form><label>mail</label><input></form>', "<script>x('<p>no</p>')</script>", '<aside><p>by the way</p></aside>', '<div class="share-buttons">tell all</div>'])
        blocks.append(noise)
    title = prose(rng, 5)
    inner = f"<h1>{title}</h1>" + "".join(blocks)
    frame = ["<article>{}</article>", '<main class="m"><div class="body">{}</div></main>', '<div class="content">{}</div>', '<div id="wrap"><div class="post-{}">{{}}</div></div>'.format(rng.randrange(99))][shell].format(inner)
    menu = "".join(f'<li><a href="/{k}">{prose(rng, 2)}</a>' for k in range(6))
    page = f'<!DOCTYPE html><html><head><title>t</title></head><body><nav><ul>{menu}</ul></nav>{frame}<div class="comments"><p>{prose(rng, 40)}</p></div><footer>&copy; foot</footer></body></html>'
    return page, " ".join([title, *text])


def test_html_equals_the_generated_articles(spark):
    rng = random.Random(12)
    made = [(n, f"https://h{n % 8}.example/{n}", *generated(rng, n % 8)) for n in range(160)]
    got = {r.page_id: r.text for r in html.extract(pages(spark, [r[:3] for r in made])).collect()}
    assert {n: (got[n], t) for n, _, _, t in made if got[n] != t} == {}


def test_html_casts_its_ids(spark):
    df = spark.createDataFrame([(1, "http://a/", "<p>some text</p>")], "page_id int, url string, html string")
    assert [tuple(r) for r in html.extract(df).collect()] == [(1, "http://a/", "some text", 9)]


def test_embeddings_of_unlike_lengths_that_meet_under_one_key(spark, monkeypatch):
    """Every vector under one key, as by chance collisions: no pair of equal lengths is lost."""
    real = embeddings._coded
    monkeypatch.setattr(embeddings, "_coded", lambda *a: real(*a).select("rid", F.lit(1).cast("long").alias("key")).distinct())
    rng = np.random.default_rng(4)
    a, b = rng.standard_normal(16), rng.standard_normal(24)
    data = [(0, a), (1, a * 2), (2, b), (3, b + 0.01), (4, rng.standard_normal(16)), (5, rng.standard_normal(24))]
    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in data], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect()}
    assert got == {0: (1, 0), 1: (1, 0), 2: (1, 2), 3: (1, 2), 4: (0, 4), 5: (0, 5)}
