"""Operators 5, 6 and 9: held-out accuracy, and exact texts of small pages."""

import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import html, langid, quality

from .conftest import EDGES

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").cache()


def test_language_accuracy(documents):
    rows = langid.identified(documents).join(documents, "doc_id").select("doc_id", "lang", "held_out", "lang_pred", "score", "text").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.98


def test_language_edges(documents, edges, none):
    model = langid.fit(documents)
    rows = langid.predicted(edges, model).collect()
    assert len(rows) == len(EDGES)
    for r in rows:
        if r.doc_id in (1, 2, 3, 9, 10):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert not next(r for r in rows if r.doc_id is None).held_out
    assert langid.predicted(none, model).count() == 0
    assert {r.lang_pred for r in langid.predicted(edges, langid.fit(none)).collect()} == {"und"}


def test_backoff_takes_longest_known():
    logs = np.log(np.array([[0.5, 0.1], [0.2, 0.2], [0.1, 0.9]], np.float32))
    keys = np.array([langid.key("known", 0), langid.key("_un", 3), langid.key("un", 2)], np.uint64)
    order = np.argsort(keys)
    p = langid.Predictor(langid.Model(["a", "b"], keys[order], logs[order]))
    assert np.allclose(p._words(["known", "unx", "zzz", "xunx"]), [logs[0], logs[1], [0, 0], logs[2]])
    assert p("known")[0] == "a" and p("xunx")[0] == "b"


def test_language_against_brute_force(spark, make):
    """Whole scores of a plain refit on a small table, with its sample smaller than the table."""
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(7001, "tie tie", "xx"), (7001, "tie tie", "xx"), (7002, None, "en"), (7003, "learn me", None), (None, "nothing known as id", "en"), (None, "nothing known as id", "en")]
    docs = make([(d, t) for d, t, _ in rows], lang=[x for _, _, x in rows])
    sample = 20
    hashes = [r.h for r in docs.select(F.xxhash64("doc_id", "text").alias("h")).collect()]
    assert len(hashes) == len(rows)
    by_lang = {}
    for (d, t, lang), x in zip([(r.doc_id, r.text, r.lang) for r in docs.collect()], hashes):
        if lang is not None and t is not None and zlib.crc32(b"" if d is None else str(d).encode()) % 3 != 1:
            by_lang.setdefault(lang, {})[x] = t
    names = sorted(by_lang)
    counts = {}
    totals = {}
    for name, found in by_lang.items():
        for x in sorted(found)[:sample]:
            for w in re.findall(r"[^\W\d_]+", found[x].lower()):
                for n in range(6):
                    m = f"_{w}_" if n > 1 else w
                    for g in [w] if n == 0 else [m[i : i + n] for i in range(len(m) - n + 1)]:
                        counts.setdefault((n, g), {}).setdefault(name, 0)
                        counts[n, g][name] += 1
                        totals[n, name] = totals.get((n, name), 0) + 1
    log = lambda n, g, name: math.log((counts[n, g].get(name, 0) + 0.5) / (totals.get((n, name), 0) + 1))

    def word(w, name):
        if (0, w) in counts:
            return log(0, w, name)
        for n in range(5, 0, -1):
            m = f"_{w}_" if n > 1 else w
            known = [g for g in (m[i : i + n] for i in range(len(m) - n + 1)) if (n, g) in counts]
            if known:
                return sum(log(n, g, name) for g in known) / len(known)
        return 0.0

    got = {}
    for r in langid.predicted(docs, langid.fit(docs, sample=sample)).collect():
        got.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
    for d, t, _ in rows:
        words = re.findall(r"[^\W\d_]+", (t or "").lower())
        if not words:
            assert set(got[d]) == {("und", 0.0)}
            continue
        sums = [sum(word(w, name) for w in words) for name in names]
        best = max(range(len(names)), key=lambda i: (sums[i], -i))
        share = 1 / sum(math.exp(max(-700, x - sums[best])) for x in sums)
        for name, score in got[d]:
            assert abs(score - share) < 2e-3 and (name == names[best] or share < 0.6), (d, name, names[best], score, share)


def test_language_ties_go_to_the_first_name(make):
    a, b = [i for i in range(20) if zlib.crc32(str(i).encode()) % 3 != 1][:2]
    docs = make([(a, "same words"), (b, "same words")], lang=["zz", "aa"])
    rows = langid.predicted(make(["same words", "other"]), langid.fit(docs)).collect()
    assert {(r.lang_pred, round(r.score, 6)) for r in rows} == {("aa", 0.5)}


def test_language_sample_is_exact_and_takes_copies_once(spark):
    rows = spark.range(3000).select(F.lit("a").alias("lang"), F.xxhash64("id").alias("h"), F.col("id").cast("string").alias("text"))
    rows = rows.unionByName(rows.where("id < 1000")).unionByName(spark.createDataFrame([("b", 5, "x")] * 2000, "lang string, h long, text string"))
    got = langid.sampled(rows, 50).collect()
    want = [r.text for r in spark.range(3000).select(F.col("id").cast("string").alias("text"), F.xxhash64("id").alias("h")).orderBy("h").limit(50).collect()]
    assert sorted(r.text for r in got if r.lang == "a") == sorted(want)
    assert [r.text for r in got if r.lang == "b"] == ["x"]


def test_quality_accuracy(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = quality.scored(docs, quality.fit(docs, labels)).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95
    good = [r.score for r in held if r.quality]
    bad = [r.score for r in held if not r.quality]
    assert np.mean([g > b for g in good for b in bad]) > 0.97


def test_quality_edges(spark, documents, edges, none):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    model = quality.fit(documents, labels)
    rows = quality.scored(edges, model).collect()
    assert len(rows) == len(EDGES) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2, 3, 10)}) == 1
    assert quality.scored(none, model).count() == 0
    kept = quality.accepted(edges, model)
    assert kept.schema == edges.schema and kept.count() == sum(r.predicted for r in rows)
    for other in (labels.limit(0), labels.where("quality = 1")):
        share = quality.scored(edges, quality.fit(documents, other)).collect()
        assert len({round(r.score, 6) for r in share}) == 1


def test_dual_coordinate_descent_reaches_the_optimum():
    """Against subgradient descent on the same primal."""
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 40, 12).astype(np.int32)) for _ in range(60)]
    labels = np.array([int(3 in r.tolist() or rng.random() < 0.4) for r in rows])
    model = quality.descend(rows, labels)
    ratios = np.sqrt(model.squares[:40].astype(float))
    x = np.zeros((60, 41))
    for i, r in enumerate(rows):
        x[i, :-1][r] = ratios[r]
        x[i, -1] = 1
        x[i] /= np.linalg.norm(x[i])
    y = np.where(labels > 0, 1, -1)
    cost = np.where(labels > 0, 1, max(1, labels.mean() / (1 - labels.mean())) ** 0.5)
    primal = lambda w: 0.5 * w @ w + (cost * np.maximum(0, 1 - y * (x @ w))).sum()
    # a ratio's sign goes into its weight here, which changes no product
    own = primal(np.append(model.scaled[:40] / np.where(ratios == 0, 1, ratios), model.constant))
    w, best = np.zeros(x.shape[1]), np.inf
    for t in range(1, 20001):
        w -= (w - ((cost * y * (y * (x @ w) < 1))[:, None] * x).sum(0)) / t
        best = min(best, primal(w))
    assert own < best * 1.02


def _plain_features(text):
    """Numbers of the features of a text, word by word."""
    from xxhash import xxh64_intdigest as h

    words, out, big = (text or "").split(), set(), 1 << 64
    forms = []
    for w in words:
        for pattern, sign in ((r"[^\W\d_a-zß-ÿ]{2,}", "U"), (r"[^\W\d_]+", "w"), (r"\d+", "9")):
            w = re.sub(pattern, sign, w)
        forms.append(h(re.sub(r"(.)\1+", r"\1+", w), 2))
    plain = [h(w.lower(), 1) for w in words]
    out |= {*plain, *forms}
    for i in range(1, len(words)):
        again = plain[i] == plain[i - 1]
        out.add((plain[i] * 0x9E3779B97F4A7C15 + plain[i - 1]) % big)
        out.add((forms[i] * 0xC2B2AE3D27D4EB4F + forms[i - 1] + again * 0x9E3779B97F4A7C15) % big)
    for i in range(3, len(words)):
        out.add(h(str(sum((plain[i - j] == plain[i - j - 1]) << (2 - j) for j in range(3))), 3))
    return sorted({x >> 44 for x in out})


def _plain_model(rows, labels):
    """Weights by feature, the constant and the ratios, with numbers of plain Python."""
    good, bad = {}, {}
    for r, y in zip(rows, labels):
        for f in r:
            side = good if y else bad
            side[f] = side.get(f, 0) + 1
    n = quality.BUCKETS
    ratio = lambda f: math.log((good.get(f, 0) + 1) / (sum(good.values()) + n)) - math.log((bad.get(f, 0) + 1) / (sum(bad.values()) + n))
    known = {f: ratio(f) for f in {*good, *bad}}
    rest = ratio(-1)
    value = lambda r: {f: known.get(f, rest) for f in r}
    x = []
    for r in rows:
        v = value(r)
        size = math.sqrt(1 + sum(z * z for z in v.values()))
        x.append(({f: z / size for f, z in v.items()}, 1 / size))
    up = (max(1, sum(labels) / (len(labels) - sum(labels)))) ** 0.5
    w, b, alpha, order = {}, 0.0, [0.0] * len(rows), np.random.default_rng(0)
    for _ in range(20):
        moved = 0.0
        for i in order.permutation(len(rows)).tolist():
            v, one = x[i]
            y = 1 if labels[i] else -1
            new = min(max(alpha[i] - (y * (sum(w.get(f, 0) * z for f, z in v.items()) + b * one) - 1), 0), 1 if labels[i] else up)
            step = (new - alpha[i]) * y
            for f, z in v.items():
                w[f] = w.get(f, 0) + step * z
            b, alpha[i], moved = b + step * one, new, max(moved, abs(step))
        if moved < 1e-3:
            break

    def margin(r):
        v = value(r)
        return (b + sum(w.get(f, 0) * z for f, z in v.items())) / math.sqrt(1 + sum(z * z for z in v.values()))

    return margin


def test_quality_against_brute_force(spark, edges):
    """Whole scores of a plain refit on a small table."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").unionByName(edges.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id <> 4 OR doc_id IS NULL").withColumn("doc_id", F.col("doc_id") + 100000))
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    labels = labels.unionByName(labels.where("doc_id % 7 = 0").withColumn("quality", F.lit(0).cast(labels.schema["quality"].dataType)))  # repeated labels: the least counts
    label, texts = {}, {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    for r in labels.collect():
        if r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 5 and r.doc_id in texts:
            label[r.doc_id] = min(int(r.quality), label.get(r.doc_id, 1))
    part = {r.id: r.p for r in spark.createDataFrame([(i,) for i in label], "id long").select("id", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3)).alias("p")).collect()}
    ids = sorted(label)
    rows, y = [_plain_features(texts[i]) for i in ids], [label[i] for i in ids]
    margins = [0.0] * len(ids)
    for k in range(3):
        rest = [j for j, i in enumerate(ids) if part[i] != k]
        margin = _plain_model([rows[j] for j in rest], [y[j] for j in rest])
        for j, i in enumerate(ids):
            if part[i] == k:
                margins[j] = margin(rows[j])
    # the curve by plain descent on the likelihood
    ones, zeros = sum(y), len(y) - sum(y)
    goal = [(ones + 1) / (ones + 2) if z else 1 / (zeros + 2) for z in y]
    slope, offset = quality._logistic(np.array(margins), np.array(y))
    loss = lambda a, b: sum(-g * math.log(p) - (1 - g) * math.log(1 - p) for m, g in zip(margins, goal) for p in [1 / (1 + math.exp(-a * m - b))])
    assert all(loss(slope, offset) <= loss(slope + da, offset + db) + 1e-9 for da in (-0.01, 0, 0.01) for db in (-0.01, 0, 0.01))
    margin = _plain_model(rows, y)
    for r in quality.scored(docs, quality.fit(docs, labels)).collect():
        if r.doc_id is not None:
            want = 1 / (1 + math.exp(-slope * margin(_plain_features(texts[r.doc_id])) - offset))
            assert abs(r.score - want) < 1e-4, (r.doc_id, r.score, want)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Site</a></header><nav><ul><li><a href="/a">one</a></li><li><a href="/b">two</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this site and you can read all about that in our long policy.</div>
{body}
<aside><h3>More</h3><p>Other stories that readers of this page have liked in the past week or so.</p></aside>
<form><label>Mail</label><input name=q><button>Go</button></form>
<div id="comments"><article class="comment"><p>I liked this article a lot and will come back to read it again soon.</p></article></div>
<footer>&copy; site</footer></body></html>"""


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", '<div class="post-content">{}</div>', "<main><article>{}<div class='ad'>Buy this now, it is really cheap today</div></article></main>"])
def test_article_alone(wrap):
    body = "<h1>A title &amp; more</h1><p><b>First   para\n of it has &eacute; words, <a href='/x'>a link</a> and a bit more text to read.<br>\n<p>Short.</p><p>The last paragraph of the article is longer again, with enough words to stand.</p>"
    want = "A title & more\n\nFirst para of it has é words, a link and a bit more text to read.\n\nShort.\n\nThe last paragraph of the article is longer again, with enough words to stand."
    assert html.extract(PAGE.format(body=wrap.format(body))) == want


def test_page_without_named_parts():
    long = "A paragraph of plain running text with no link in it that goes on for quite some words, as articles do."
    page = f"<body><div><a href=1>Home</a> <a href=2>News</a></div><div><p>{long}</p><p>{long}</p></div><div><a href=3>Imprint</a></div>"
    assert html.extract(page) == f"{long}\n\n{long}"


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<!--", "<script>x", "a < b & c > d", "</p></p>", "<p title='>", "<article><p>x" + "<b>" * 3000, "&" * 100 + "<a href=\"" * 200])
def test_broken_pages(page):
    assert isinstance(html.extract(page), str)


def test_stray_end_tags_in_deep_nesting_take_linear_time():
    n = 100_000
    assert html.extract("<article>" + "<div>" * n + "</section>" * n + "text of it</article>") == "text of it"


def test_pages_table(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    rows = html.extracted(pages).collect()
    assert len(rows) == pages.count() and all(r.n_chars == len(r.text) for r in rows)
    source = {r.page_id: r.html for r in pages.collect()}
    import html as h
    import re

    for r in rows:
        article = re.search("<article>(.*?)</article>", source[r.page_id], re.S)
        parts = [" ".join(h.unescape(re.sub("<b>|</b>|<br>", "", x)).split()) for x in re.split("</?(?:p|h1)>", article[1])]
        assert r.text == "\n\n".join(p for p in parts if p)
    edge = spark.createDataFrame([(1, None, None, 5), (None, "u", "<p>x", 6), (2, "u", "", 7)], "page_id long, url string, html string, text int")
    assert html.extracted(edge).count() == 3 and html.extracted(edge.limit(0)).count() == 0


def test_quality_notes_runs_of_repeats():
    from plumbline.llm.quality import _SHIFT, RUNS, Features

    features, runs = Features(), (RUNS >> _SHIFT).tolist()
    assert runs[7] in features("so so so so it goes") and runs[7] not in features("so so so it goes on")
    assert runs[0] in features("no word comes twice") and not set(runs) & set(features("only three words").tolist())


def test_quality_takes_whole_words_and_rare_ones():
    """Words that differ after many characters, or that one text alone has, are features of their own."""
    from plumbline.llm.quality import Features, shape

    assert shape("!?" * 10 + "a") != shape("!?" * 10 + "1")
    features = Features()
    assert set(features("once").tolist()) - set(features("other").tolist())
