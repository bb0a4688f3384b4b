"""Classifiers, URL models and the block labeller: held-out accuracy, brute force, defined results on odd rows."""

import math
import re
import time
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seriesward.llm import html_blocks as hb
from seriesward.llm import labelled, quality, toxicity, urls
from seriesward.llm.queries import RULES

SF = "/root/testdata/sf0.01"


def _read(spark, table):
    return spark.read.parquet(f"{SF}/{table}.parquet")


@pytest.mark.parametrize(("model", "label", "least", "accuracy"), [(toxicity, "toxic", 0.5, 0.9), (quality, "quality", 0.3, 0.95)])
def test_held_out_accuracy(spark, model, label, least, accuracy):
    docs, marks = _read(spark, "documents"), _read(spark, "labels")
    rows = model.score(docs, model.train(docs, marks)).join(marks, "doc_id").where(labelled.held_out(F.col("doc_id")))
    rows = rows.select(label, "score").collect()
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum((r.score >= least) == r[label] for r in rows) / len(rows) >= accuracy


@pytest.mark.parametrize("model", [toxicity, quality])
def test_odd_rows(spark, model):
    docs = spark.createDataFrame([(1, None, 3.0), (None, "", 1.0), (2, "word " * 30_000, 0.0), (2, "word " * 30_000, 0.0)], "doc_id long, text string, _text double")
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = model.score(docs, model.train(docs, empty, "toxic")).collect()
    assert [r.score for r in out] == [0.5] * 4
    assert model.score(docs, {model.BIAS: 1.0, model.SLOPE: 1.0}).columns == ["doc_id", "text", "_text", "score"]
    assert model.score(docs.where("false"), {}).count() == 0


def test_held_out_fold_is_never_sampled(spark):
    docs, marks = _read(spark, "documents"), _read(spark, "labels")
    rows = labelled.sample(docs, marks, "toxic", 30)
    assert rows.where(labelled.held_out(F.col("doc_id"))).count() == 0
    assert rows.groupBy("label").count().where("count > 30").count() == 0


def test_ftrl_is_sparse_and_finds_the_signal():
    rng = np.random.default_rng(0)
    labels = (np.arange(400) % 2).astype(int)
    rows = [np.unique(np.append(rng.integers(10, 5000, 40), [3] if y else [4])) for y in labels]
    w = toxicity.descend(labels, rows)
    assert w[3] > 1 and w[4] < 0.1
    assert (w != 0).sum() < 300


def test_dual_descent_reaches_the_optimum():
    """Against the primal: no direction lowers the objective."""
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 12, 5)) for _ in range(60)]
    signs = np.where([3 in x or 5 in x for x in rows], 1.0, -1.0)
    scales = np.zeros(quality.SIZE)
    scales[:12] = rng.standard_normal(12)
    w = quality.dual_descent(signs, rows, scales, 0.5, 400)
    x = np.zeros((60, 13))
    for k, r in enumerate(rows):
        x[k, r] = scales[r]
        x[k, 12] = 1
    v = np.append(w[:12] / scales[:12], w[quality.BIAS])
    objective = lambda v: 0.5 * v @ v + 0.5 * np.maximum(0, 1 - signs * (x @ v)).sum()
    assert all(objective(v) <= objective(v + 0.02 * rng.standard_normal(13)) + 2e-3 for _ in range(300))


def _brute_urls(rows):
    """Rules, models and threshold in plain Python."""
    parts = []
    for i, u in rows:
        u = u or ""
        m = re.match(r"[^/?#]*", u.split("://", 1)[1]) if "://" in u else None
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[0]) if m else ""
        path = re.match(r"[^/?#]*([^?#]*)", u.split("://", 1)[1])[1] if m else ""
        fits = [(len(r), r, v) for v, r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        parts.append((i, u, host, path, *(max(fits)[1:] if fits else (None, None))))
    n, before = [Counter(), Counter()], [Counter(), Counter()]
    padded = {u: "\x02" * 4 + u + "\x03" for _, u, *_ in parts}
    for _, u, _, _, _, told in parts:
        if told:
            for e in range(5, len(padded[u]) + 1):
                for k in range(1, 6):
                    n[told == "block"][padded[u][e - k : e]] += 1
                    before[told == "block"][padded[u][e - k : e - 1], k] += 1

    def p(side, gram):
        out = 1 / 256
        for k in range(1, 6):
            g = gram[5 - k :]
            out = (n[side][g] + 2 * out) / (before[side][g[:-1], k] + 2)
        return out

    total = {u: sum(round((math.log(p(0, x[e - 5 : e])) - math.log(p(1, x[e - 5 : e]))) * 1e6) for e in range(5, len(x) + 1)) for u, x in padded.items()}
    size = {u: len(u) + 1 for u in padded}
    bins = [(max(-1000, min(1000, math.floor(total[u] / (size[u] * 10_000)))), told) for _, u, _, _, _, told in parts if told]
    good, bad = sum(t == "allow" for _, t in bins), sum(t == "block" for _, t in bins)
    gains = [(-round(sum(b < t and v == "block" for b, v in bins) / max(bad, 1) - sum(b < t and v == "allow" for b, v in bins) / max(good, 1), 9), abs(t), t) for t in {b for b, _ in bins}]
    limit = min([*gains, (2.0, 0, 0)])[2]
    return sorted(str((i, h, q, r, v or ("allow" if total[u] >= limit * 10_000 * size[u] else "block"))) for i, u, h, q, r, v in parts)


def test_urls(spark):
    rows = [(r.page_id, r.url) for r in _read(spark, "pages").collect()]
    rows += [(9000, None), (9001, ""), (9002, "no scheme/de/"), (9003, "HTTP://Sub.ORG"), (9004, "x://org/a://b?c#d"), (9005, "x://Éa.COM/de/ü?/fr/"), (9006, "x://notorg/"), (None, rows[3][1]), (9007, rows[3][1]), (9008, "h://y.net/" + "a/" * 3000)]
    table = spark.createDataFrame([(i, u, 1) for i, u in rows], "page_id long, url string, host int")
    got = urls.judged(table, RULES).drop("score").collect()
    assert sorted(str(tuple(r)) for r in got) == _brute_urls(rows)
    assert urls.judged(table.where("false"), RULES).count() == 0
    assert {r.verdict for r in urls.judged(table, [("allow", "nowhere/")]).collect()} == {"allow"}


def test_url_plan_runs_no_python(spark):
    plan = urls.judged(_read(spark, "pages"), RULES)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|MapInArrow", plan)


def test_sample_bounds_the_rows_and_takes_labels_of_present_documents(spark):
    marks = spark.createDataFrame([(k, k % 2) for k in range(4000)], "doc_id long, toxic int")
    rows = [(k, f"text {k}") for k in range(0, 4000, 50)] + [(k, f"text {k}") for k in range(1, 4000, 50)]
    rows += [(rows[1][0], f"other {k % 7}") for k in range(400)] + [(None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = labelled.sample(docs, marks, "toxic", 20).collect()
    assert Counter(r.label for r in got) == {0: 20, 1: 20}
    assert len({r.doc_id for r in got}) == 40
    whole = labelled.sample(docs, marks, "toxic").collect()
    present = {i for i, _ in rows if i is not None}
    assert len(whole) == len({r.doc_id for r in whole}) and {r.doc_id for r in whole} <= present
    assert sorted(map(tuple, labelled.sample(docs.repartition(5), marks, "toxic").collect())) == sorted(map(tuple, whole))


def test_sample_stores_no_file_per_partition(spark, monkeypatch):
    marks = spark.createDataFrame([(k, k % 2) for k in range(400)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(400)], "doc_id long, text string").repartition(3)
    stored, store = [], labelled.materialise
    monkeypatch.setattr(labelled, "materialise", lambda df: stored.append(store(df)) or stored[-1])
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = labelled.sample(docs, marks, "toxic", 30).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert Counter(r.label for r in rows) == {0: 30, 1: 30}
    assert sum(len(df.inputFiles()) for df in stored) <= 2


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><nav><ul><li><a href="/a">One</a><li>Two</ul></nav>
<!-- <p>no</p> --><article class="post"><h1>Head &amp; line</h1><p>First  <b>bold</b>&nbsp;text<br>goes on<p>Second &lt;x&gt; &#233;</article><footer>&copy; foot</footer>tail"""


def test_leaves():
    got = [(x.path[-1][0], x.text, x.linked) for x in hb.leaves(PAGE)]
    assert got == [("li", "One", 3), ("li", "Two", 0), ("h1", "Head & line", 0), ("p", "First bold text goes on", 0), ("p", "Second <x> é", 0), ("footer", "© foot", 0), ("body", "tail", 0)]
    assert hb.leaves(None) == hb.leaves("") == hb.leaves("<p>") == []
    assert [x.text for x in hb.leaves("plain <i>text")] == ["plain text"]
    assert hb.labels(hb.leaves(PAGE)).tolist() == [False, False, True, True, True, False, False]


@pytest.mark.parametrize(
    ("before", "shown"),
    [
        ("<head><title>T</title><body>", ""),
        ("<head><title>T</title><meta charset=x><script>'</head><p>no'</script><style>p{}</style>", ""),
        ("<head><title>a <!-- b</title></head><body>", ""),
        ("<head><title>T</title>Bare text", "Bare text"),
        ("<html><head></meta><link rel=x></head><body>", ""),
        ("<head><noscript><iframe></iframe></noscript><title>T</title></head>", ""),
        ("<body><svg class=\"i\"/>", ""),
        ("<body><canvas/>", ""),
        ("<body><svg><title>Icon</title><svg/><svg><text>no</text></svg>no</svg>", ""),
        ("<body><textarea>no <!-- no</textarea><noscript><p>no</p></noscript>", ""),
        ("<body><svg-icon>", ""),
        ("<body><iframe src=x>", ""),
        ("<body><object data=/a/>", ""),
        *((f"<body><{name} id='a'>", "") for name in ("svg", "iframe", "object", "canvas", "textarea", "select", "noscript", "template")),
    ],
)
def test_leaves_after_what_has_no_end_tag(before, shown):
    got = [x.text for x in hb.leaves(before + "<article><p>Main text</p></article>")]
    assert got == [shown, "Main text"] if shown else got == ["Main text"]
    got = [x.text for x in hb.leaves(before + "<article><p>Main text</p></article><svg></svg><canvas></canvas><object></object>")]
    assert got[-1] == "Main text"


def test_leaves_of_many_unclosed_elements_take_linear_time():
    for name in ("iframe", "svg"):
        began = time.process_time()
        assert len(hb.leaves(f"<{name}><p>x</p>" * 50_000)) == 50_000
        assert time.process_time() - began < 10


def test_gradients():
    rng = np.random.default_rng(4)
    p = {k: v.astype(np.float64) for k, v in hb.fresh(rng, 5, 3).items()}
    x, y = rng.standard_normal((6, 4, 5)), (rng.random((6, 4)) > 0.5).astype(float)
    mask = (np.arange(6)[:, None] < [6, 3, 1, 4]).astype(float)

    def loss():
        z = hb.logits(p, x, mask).astype(np.float64)
        return float(((np.logaddexp(0, z) - y * z) * mask).sum() / mask.sum())

    grads = hb.gradients(p, x, mask, y)
    for name, v in p.items():
        for _ in range(6):
            at = tuple(int(rng.integers(n)) for n in v.shape)
            old = v[at]
            v[at] = old + 1e-2
            up = loss()
            v[at] = old - 1e-2
            down = loss()
            v[at] = old
            assert abs((up - down) / 2e-2 - grads[name][at]) < 2e-3


def test_extraction_on_pages_not_learnt_from(spark):
    pages = _read(spark, "pages")
    model = hb.train(pages, 120)
    rows = pages.collect()
    want = {r.page_id: "\n\n".join(x.text for x, keep in zip(own, hb.labels(own)) if keep) for r in rows for own in [hb.leaves(r.html)]}
    got = {r.page_id: r for r in hb.extract(pages, model).collect()}
    assert sum(got[k].text == t for k, t in want.items()) >= 0.99 * len(want)
    assert all(r.n_chars == len(r.text) for r in got.values())
    odd = spark.createDataFrame([(1, "u", None, 5), (2, None, "", 5), (None, "u", "<p>" + "long text. " * 9000, 5), (3, "u", "<nav><li>x" * 2000, 5)], "page_id long, url string, html string, text int")
    out = hb.extract(odd, model).collect()
    assert [(r.page_id, r.text, r.n_chars) for r in out[:2]] == [(1, "", 0), (2, "", 0)]
    assert hb.extract(odd.where("false"), model).count() == 0
    assert {r.text for r in hb.extract(odd, hb.train(odd.where("false"))).collect()} == {""}


def test_other_layouts():
    """Layouts in which no article element marks the text."""
    rows = _pages()
    model = hb.learn(rows)
    page = "<html><body><header><h1>Site</h1></header><div class='cookie-notice'>We use cookies.</div><main><h1>Title of it</h1>" + "".join(
        f"<p>{' '.join(x.text for x in rows[k] if x.path[-1][0] == 'p')[:400]}.</p>" for k in range(4)
    ) + "</main><aside class='sidebar'><p>Read this too.</p></aside><section class='comments'><p>I liked it.</p></section><form><label>Mail</label></form><footer><p>Imprint</p></footer></body></html>"
    own = hb.leaves(page)
    assert hb.classify(model, [own])[0].tolist() == [x.path[2][0] == "main" for x in own]


@pytest.mark.parametrize(
    "unit", ["<a ", "<a x=\"", "<a x='>", "<!--", "<div>", "<div>x", "<p a=\"b'>x", "</x>", "<script>", "<b x=y z='", "< ", "<p><svg>", "<!"]
)
def test_leaves_of_any_markup_take_linear_time(unit):
    for page in (unit * 60_000, "<div>" * 30_000 + unit * 30_000, unit * 60_000 + ">"):
        began = time.process_time()
        hb.leaves(page)
        assert time.process_time() - began < 6


@pytest.mark.parametrize(
    ("page", "shown"),
    [
        ("<p title='it's'>x</p>", ["x"]),
        ("<p title=it's>x</p><p b=\"1>2\" c='>'>y</p>", ["x", "y"]),
        ("<p a=\"oops>x</p><p>y", ["x", "y"]),
        ("<p \"quoted>x</p>", ["x"]),
        ("a < b <p>z</p> c <d", ["a < b", "z", "c <d"]),
        ("t <!-- c", ["t"]),
        ("<p = 'a'>x<p x = 'a>b'>y", ["x", "y"]),
        ("<script x='</script>'>no</script>yes", ["yes"]),
    ],
)
def test_leaves_of_stray_quotes_and_brackets(page, shown):
    assert [x.text for x in hb.leaves(page)] == shown


PROSE = (
    "The river had been rising since the morning, and by noon the lower meadows were under water, so the farmers moved their cattle to the hill behind the church.",
    "Nobody could remember a spring like this one, although the oldest of them spoke of a year when the mill itself was carried away in the night.",
    "When the rain stopped at last, they went down together to look at the bridge, which stood, but leaned a little towards the far bank.",
    "It took them four weeks to repair it, with timber from the woods above the village and iron that was brought by cart from the town.",
    "On the day it was opened again there was music, and the children ran across it, back and forth, until it was dark.",
)
MENU = "".join(f"<li><a href='/{x}'>{x}</a></li>" for x in ("Home", "News", "Sport", "Culture", "Contact"))
FOOT = "<div><a href='/i'>Imprint</a> <a href='/p'>Privacy</a></div>"


def _page(body, attributes=""):
    return f"<html><head><title>Site</title></head><body{attributes}>{body}</body></html>"


#: Pages whose truth is written by hand: all prose belongs to the article, no menu and no footer does.
HAND_WRITTEN = {
    "divs": _page(f"<div><ul>{MENU}</ul></div><div><h1>The flood</h1>{''.join(f'<div>{x}</div>' for x in PROSE)}</div>{FOOT}"),
    "paragraphs": _page(f"<div><ul>{MENU}</ul></div><div><h1>The flood</h1>{''.join(f'<p>{x}</p>' for x in PROSE)}</div>{FOOT}"),
    "no heading": _page(f"<ul>{MENU}</ul><div>{''.join(f'<div><div>{x}</div></div>' for x in PROSE)}</div>{FOOT}"),
    "foreign names": _page(f"<div class='k1'><ul class='k2'>{MENU}</ul></div><div class='zz9'>{''.join(f'<div class=qq>{x}</div>' for x in PROSE)}</div>{FOOT}"),
    "body with a sidebar class": _page(f"<nav><ul>{MENU}</ul></nav><article><h1>The flood</h1>{''.join(f'<p>{x}</p>' for x in PROSE)}</article><footer><p>Imprint</p></footer>", " class='has-sidebar'"),
    "body with comments": _page(f"<nav><ul>{MENU}</ul></nav><main>{''.join(f'<p>{x}</p>' for x in PROSE)}</main><footer><p>Imprint</p></footer>", " class='single with-comments'"),
    "whole page in a form": _page(f"<form id='main-form'><nav><ul>{MENU}</ul></nav><div>{''.join(f'<p>{x}</p>' for x in PROSE)}</div></form>"),
    "sections": _page(f"<header><ul>{MENU}</ul></header>{''.join(f'<section><p>{x}</p></section>' for x in PROSE)}<footer>{FOOT}</footer>"),
    "table": _page(f"<table><tr><td><ul>{MENU}</ul></td><td>{''.join(f'<p>{x}</p>' for x in PROSE)}</td></tr></table>"),
    "quotes": _page(f"<nav title='it's'><ul>{MENU}</ul></nav><article title=\"it's\">{''.join(f'<p>{x}</p>' for x in PROSE)}</article>"),
}


def test_hand_written_pages_keep_their_prose():
    model = hb.learn(_pages())
    for name, page in HAND_WRITTEN.items():
        own = hb.leaves(page)
        kept = {x.text for x, keep in zip(own, hb.classify(model, [own])[0]) if keep}
        assert set(PROSE) <= kept, name
        assert not kept & {"Home", "News", "Sport", "Culture", "Contact", "Imprint", "Imprint Privacy"}, name


def test_body_names_and_names_of_the_whole_page_tell_nothing():
    for name in ("body with a sidebar class", "body with comments", "whole page in a form"):
        own = hb.leaves(HAND_WRITTEN[name])
        assert [x.text for x, y in zip(own, hb.labels(own)) if y and x.text in PROSE] == list(PROSE), name


def test_quality_with_a_fold_of_one_class():
    """Whatever the order of the labels, the curve sees both classes."""
    rng = np.random.default_rng(1)
    labels = np.array([k % 5 == 4 for k in range(200)]).astype(int)  # every fifth row is good
    rows = [np.unique(np.append(rng.integers(0, 50, 8), 60 + y)) for y in labels]
    numbers, weights = quality.fit(labels, rows)
    model = dict(zip(numbers.tolist(), weights.tolist()))
    assert model[quality.SLOPE] > 0.1
    score = lambda x: 1 / (1 + np.exp(-(model[quality.SLOPE] * (sum(model.get(k, 0.0) for k in x.tolist()) + model.get(quality.BIAS, 0.0)) + model[quality.SHIFT])))
    assert min(score(x) for x, y in zip(rows, labels) if y) > quality.KEEP > max(score(x) for x, y in zip(rows, labels) if not y)
    assert len(quality.fit(np.array([0, 0, 0, 1]), rows[:4])[0])


def _pages():
    import pyarrow.parquet as pq

    return [hb.leaves(h) for h in pq.read_table(f"{SF}/pages.parquet", columns=["html"])["html"].to_pylist()]


def test_arrow_slices_of_a_text_column_are_whole():
    from seriesward.llm import text as tx

    batch = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "b" * 50, "", "c"]})
    cut = list(tx.slices([batch, batch.slice(0, 0)], "text", 20))
    assert [x for b in cut for x in b.column("text").to_pylist()] == batch.column("text").to_pylist()
    assert [b.num_rows for b in cut] == [2, 1, 2] or sum(b.num_rows for b in cut) == 5
    assert tx.filled(cut[-1].column("text")).to_pylist() == ["", "c"]


def test_texts_go_to_the_workers_once_and_in_small_slices(spark):
    docs = spark.createDataFrame([(k, "word " * 20_000, 7) for k in range(40)], "doc_id long, text string, other int").coalesce(1)
    rows = labelled.scored(docs, lambda texts: np.full(len(texts), float(sum(len(t.as_py()) for t in texts))), "score")
    assert rows.columns == ["doc_id", "text", "other", "score"]
    assert max(r.score for r in rows.select("score").collect()) <= 600_000
    assert "_text" not in rows._jdf.queryExecution().optimizedPlan().toString()
    cast = docs.withColumn("text", F.col("text").cast("binary"))  # no string: sent as one beside it
    assert labelled.scored(cast, lambda texts: np.full(len(texts), 1.0), "score").select("doc_id", "other", "score").distinct().count() == 40


def test_dual_descent_holds_each_feature_once_in_four_bytes():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, quality.SIZE, 4000)).astype(np.int32) for _ in range(2000)]
    signs = np.where(rng.random(len(rows)) < 0.5, 1.0, -1.0)
    tracemalloc.start()
    try:
        quality.dual_descent(signs, rows, np.ones(quality.SIZE), 0.02, 1)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 6 * sum(map(len, rows)) + 4 * 8 * quality.SIZE  # and a few arrays of weights
