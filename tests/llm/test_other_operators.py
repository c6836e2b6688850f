"""Vectors, captures, conversations and the pipeline against plain Python."""

import random
from datetime import date, timedelta

import pytest
from brute import same, top_products

import corpus_pipeline
from barline.llm import chat, topk, url_filter
from barline.llm.common import offsets_of_parts


@pytest.mark.parametrize("bucket,block", [(8192, 512), (40, 3)])
def test_top_products(spark, bucket, block):
    r = random.Random(2)
    vectors = [(i, [r.gauss(0, 1 + i % 5) for _ in range(6)]) for i in range(400)]
    vectors += [(1000 + i, [0.5] * 6) for i in range(150)] + [(2000 + i, [-0.25] * 6) for i in range(60)]
    vectors += [(5000, None), (5001, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (5002, [float("nan")] * 6), (5003, [float("inf")] * 6), (None, [1.0] * 6),
                (5020, []), (5021, []), (5040, [1.0, 2.0]), (5041, [3.0, -1.0]), (5041, [3.0, -1.0]), (5060, [0.0] * 6), (5080, [1e7] * 6), (5100, [1.0, 2.0, 3.0])]
    frame = spark.createDataFrame([(*v, 1, 2) for v in vectors], "vec_id long, embedding array<double>, id int, dims int")
    got = topk.top_inner_products(frame, bucket=bucket, block=block)
    same(got, top_products(vectors))


@pytest.mark.parametrize("bucket,block", [(8192, 512), (7, 2)])
def test_top_products_of_huge_finite_vectors(spark, bucket, block):
    """Components of any finite size, beside small ones, as queries and as candidates."""
    r = random.Random(9)
    vectors = [(20, [1.0, 1.0]), (21, [6e7, 1.0]), (22, [2.0, 3.0])]
    vectors += [(i, [r.choice([-1, 1]) * r.choice([1.5, 3e7, 4e9, 1e20, 1e300]) * r.random(), r.gauss(0, 2)]) for i in range(40, 100)]
    vectors += [(200, [1.7e308, -1.7e308]), (201, [1.7e308, 1.7e308]), (202, [-1.7e308, 1e-300]), (220, [5e7, 1.0]), (221, [5e7, 1.0])]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    same(topk.top_inner_products(frame, bucket=bucket, block=block), top_products(vectors))
    assert (20, 21, 245760004096) in {(x.query_id, x.vec_id, x.score) for x in topk.top_inner_products(frame.filter("vec_id < 23")).collect()}
    assert sorted(topk.order_key(s) for s in (-(10**30), -12, -2, -1, 0, 1, 2, 12, 10**30)) == [topk.order_key(s) for s in (-(10**30), -12, -2, -1, 0, 1, 2, 12, 10**30)]


@pytest.mark.parametrize("bucket", [8192, 16])
def test_top_products_of_repeated_rows(spark, bucket):
    r = random.Random(10)
    vectors = [(i, [r.gauss(0, 1) for _ in range(3)]) for i in range(60)]
    vectors += [vectors[7]] * 30 + [vectors[11]] * 2 + [vectors[20]] * 3 + [(20, [9.0, 9.0, 9.0])]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    same(topk.top_inner_products(frame, bucket=bucket, block=4), top_products(vectors))


def test_top_products_prunes_and_stays_exact():
    import numpy as np

    r = np.random.default_rng(4)
    vectors = r.integers(-60, 60, (3000, 16))
    vectors[:40] = vectors[0] + r.integers(-2, 3, (40, 16))
    vectors = vectors[np.argsort(-(vectors**2).sum(axis=1), kind="stable")]
    queries, ids = np.concatenate((vectors[::300], vectors[:1])), np.arange(3000)
    scores = queries @ vectors.T
    floors = np.sort(scores, axis=1)[:, -5]
    floors[-1] = -(2**63)
    q, v, s = topk.search_bucket(-1 - np.arange(len(queries)), queries, floors, ids, vectors, 5)
    for i in range(len(queries)):
        best = sorted(zip(-scores[i], ids))[:5]
        assert sorted(zip(-s[q == -1 - i], v[q == -1 - i])) == best


def test_top_products_empty(spark):
    assert topk.top_inner_products(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    few = spark.createDataFrame([(1, [1.0]), (3, [2.0])], "vec_id long, embedding array<double>")
    assert topk.top_inner_products(few).count() == 0


def test_offsets_of_parts(spark):
    rows = [("a", i, i % 7 + 1) for i in range(50)] + [("b", 5, 9)]
    frame = spark.createDataFrame(rows, "k string, o long, v long")
    got = {(r.k, r.o): r.x for r in offsets_of_parts(frame, ["k"], "o", "v", "x", run=8).collect()}
    assert got == {(k, o): sum(v for j, p, v in rows if j == k and p < o) for k, o, _ in rows}
    most = {(r.k, r.o): r.x for r in offsets_of_parts(frame, ["k"], "o", "v", "x", run=8, how="max").collect()}
    assert most == {(k, o): max([v for j, p, v in rows if j == k and p < o], default=0) for k, o, _ in rows}


DAY = date(2024, 1, 1)
EVENTS = [("l", "bad.com", "add", 1), ("l", "bad.com", "add", 3), ("l", "bad.com", "remove", 10), ("l", "bad.com", "add", 20), ("m", "x.bad.com", "add", 5),
          ("m", "ok.org/p", "add", 0), ("m", "ok.org/", "remove", 4), ("l", "both.net", "add", 2), ("l", "both.net", "remove", 2),
          (None, "bad.com", "add", 0), ("l", None, "add", 0), ("l", "bad.com", None, 0), ("l", "bad.com", "other", 0)]
URLS = ["http://bad.com", "https://u:p@X.Bad.com:80/a?b#c", "http://notbad.com/", "ftp://a.x.bad.com/z", "http://ok.org/p?q=1", "http://ok.org/p/q", "http://ok.org",
        "nothing", "", None, "http://both.net/", "http:///x", "http://" + "a." * 5000 + "bad.com/", "http://bad.com/" + "x/" * 50_000,
        "http://" + "b" * 247 + ".bad.com/", "http://" + "c" * 245 + ".bad.com", "http://xbad.com", "http://" + "d" * 300 + "bad.com/"]


def active(url_keys, day):
    found = set()
    for name, entry in {(a, b) for a, b, *_ in EVENTS if a and b}:
        daily = {}
        for a, b, action, d in EVENTS:
            if (a, b) == (name, entry) and action in ("add", "remove"):
                daily[d] = max(action, daily.get(d, ""))
        state = [daily[d] for d in sorted(daily) if d <= day]
        if state and state[-1] == "add" and entry in url_keys:
            found.add(f"{name}:{entry}")
    return found


def keys_of(url):
    import re

    m = re.match(r"([a-z]+)://(?:[^/?#]*@)?([^/?#:]+)(?::\d+)?([^?#]*)", url or "")
    if not m:
        return set()
    host = m[2].lower()
    return {".".join(host.split(".")[i:]) for i in range(host.count(".") + 1)} | {host + (m[3] or "/")}


def test_url_filter(spark):
    events = spark.createDataFrame([(a, b, c, DAY + timedelta(d)) for a, b, c, d in EVENTS] + [("l", "bad.com", "add", None)], "list string, entry string, action string, day date")
    rows = [(k, u, DAY + timedelta(d), "e") for k, (u, d) in enumerate((u, d) for u in URLS for d in (0, 2, 5, 9, 10, 25))]
    rows += [rows[1]] * 3 + [(None, URLS[0], None, "e")]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched date, entry string")
    got = [(r.capture.page_id, r.capture.url, r.capture.fetched, r.capture.entry, r.blocked, r.n_entries, tuple(r.entries)) for r in url_filter.filter_captures(captures, events).collect()]
    expected = []
    for k, u, d, e in rows:
        found = tuple(sorted(active(keys_of(u), (d - DAY).days))) if d else ()
        expected.append((k, u, d, e, bool(found), len(found), found))
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert not any(r.blocked for r in url_filter.filter_captures(captures, events.limit(0)).collect())
    assert url_filter.filter_captures(captures.limit(0), events).count() == 0


def test_chat(spark):
    convs = {1: ["a", "b"], 2: ["a", "b", "c"], 3: ["a", "b", "c"], 4: ["a", "x"], 5: ["a"], 6: [None, ""], 7: [""], 8: ["q"] * 3000, 9: ["q"] * 2999, 10: ["<|im_end|>"]}
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", text, 1) for c, texts in convs.items() for t, text in enumerate(texts)]
    rows += [(11, None, None, None, 1), (12, 3, "user", "gap", 1), (12, 7, "user", "gap", 1), (None, 0, "user", "a", 1), (None, 0, "user", "lone", 1), (None, 5, "user", "lone", 1),
             (13, 0, "user", "twice", 1), (13, 0, "user", "twice", 1), (14, 0, "user", "twice", 1)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, position int").repartition(3)
    whole = {}
    for c, t, role, text, _ in rows:
        if c is not None:
            whole.setdefault(c, []).append((t is not None, t or 0, role or "", role, text))
    whole = {c: tuple((x[3], x[4]) for x in sorted(v, key=lambda x: x[:3])) for c, v in whole.items()}
    whole_lone = {("lone", i): (x,) for i, x in enumerate({(r[2], r[3]) for r in rows if r[0] is None})}
    kept = {}
    for c, v in [*sorted(whole.items()), *whole_lone.items()]:
        if v in kept.values() or any(len(o) > len(v) and o[:len(v)] == v for o in whole.values()):
            continue
        kept[c] = v
    show = lambda v: "".join(f"<|im_start|>{r or ''}\n{(t or '').replace('<|im_', '< |im_')}<|im_end|>\n" for r, t in v)
    same(chat.collapse_and_render(frame), [(None if isinstance(c, tuple) else c, len(v), show(v)) for c, v in kept.items()])
    assert chat.collapse_and_render(frame.limit(0)).count() == 0


def test_pipeline_stages(spark, awkward, no_documents, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "jaccard_join", "substring_dedup", "benchmark_decontamination", "packing"]
    spark.createDataFrame([(1, awkward.filter("doc_id = 16").first().text)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for first in (awkward, no_documents):
        docs = first
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            if name != "packing":
                assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{name}-{first is awkward}")
            docs = spark.read.parquet(f"{tmp_path}/{name}-{first is awkward}")
        left = {r.doc_id for r in docs.collect()}
        assert left == ({1, 9, 10, 11, 12, 14, 18, 20, 21, 22, 23, 24, -5, None} & left if first is awkward else set())
    assert {5, 6, 7, 8}.isdisjoint(left) and 16 not in left
