"""Quality votes, the conversation trie and the filter audit against plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest
from brute import same

from barline.llm import filter_audit, quality, turn_trie

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.01"


# quality

LABELS = "doc_id long, quality int, toxic int, text string, key string, source string"


def test_quality_of_held_out_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.classify(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    good, low = [r for r in got if r.quality == 1], [r for r in got if r.quality == 0]
    assert len(good) > 50 and len(low) > 5
    assert np.mean([r.predicted for r in good]) >= 0.98 and np.mean([r.predicted for r in low]) <= 0.1
    wins = [(a.score > b.score) + (a.score == b.score) / 2 for a in good for b in low]
    assert np.mean(wins) > 0.98


def test_quality_votes_by_hand(spark):
    r = random.Random(3)
    texts = [" ".join(r.choice(["alpha", "beta", "gamma", "DELTA!!", "x | y", "12%"]) for _ in range(r.randint(1, 40))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)]
    marks = [(i, int("DELTA" not in t)) for i, t in rows]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int")
    taught = sorted({(hashlib.md5(t.encode()).hexdigest(), q, t) for (i, t), (_, q) in zip(rows, marks) if zlib.crc32(str(i).encode()) % 4 != 2})
    terms = quality.term_vectors([t.encode() for _, _, t in taught])
    _, _, axes = np.linalg.svd(terms.astype(np.float64), full_matrices=False)
    unit = lambda x: x / np.linalg.norm(x)
    space = [unit(axes[:64] @ v) for v in terms]
    for row in quality.classify(docs, labels).collect():
        own = unit(axes[:64] @ quality.term_vectors([texts[row.doc_id].encode()])[0])
        cosines = sorted(((round(float(own @ v), 6), -k, taught[k][1]) for k, v in enumerate(space)), reverse=True)[:15]
        weights = [max(c, 0) ** 4 for c, _, _ in cosines]
        expected = sum(w * q for w, (_, _, q) in zip(weights, cosines)) / sum(weights)
        assert row.score == pytest.approx(expected, abs=2e-3) and row.predicted == int(row.score >= 0.7)
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 4 == 2)


def test_quality_awkward(spark, awkward, no_documents):
    marks = [(i, i % 2, 0, "t", "k", "s") for i in range(1, 26)] + [(1, 0, 1, "t", "k", "s"), (1, 0, 1, "t", "k", "s"), (None, 1, 0, "", "", ""), (3, None, 0, "", "", ""), (4, 7, 0, "", "", "")]
    labels = spark.createDataFrame(marks, LABELS)
    got = quality.classify(awkward, labels).collect()
    assert len(got) == awkward.count() and all(0 <= r.score <= 1 for r in got)
    wordless = {r.score for r in got if r.doc_id in (5, 6, 7)}
    assert len(wordless) == 1 and wordless.pop() not in (0, 1)
    assert len({r.score for r in got if r.doc_id == 10}) == 1 and not any(r.held_out for r in got if r.doc_id is None)
    # nothing to learn from, one label alone, no documents
    assert {(r.score, r.predicted) for r in quality.classify(awkward, labels.limit(0)).collect()} == {(0.5, 0)}
    assert {r.score for r in quality.classify(awkward, labels.filter("quality = 1")).collect()} == {1.0}
    assert quality.classify(no_documents, labels).count() == 0
    # the sample is bounded by texts, copies count once
    copies = spark.createDataFrame([(i, f"word{i % 7} and more", "x") for i in range(400)], "doc_id long, text string, key string")
    chosen, share = quality.labelled_sample(copies, spark.createDataFrame([(i, int(i < 300), 0, "", "", "") for i in range(400)], LABELS), sample=5)
    assert sorted(r.quality for r in chosen.collect()) == [0] * 5 + [1] * 5 and 0.6 < share < 0.9


def test_terms_of_long_texts_by_chunks(monkeypatch):
    text = " ".join(f"word{i % 977}" for i in range(3000)).encode()
    whole = quality.term_vectors([text])
    monkeypatch.setattr(quality, "CHUNK", 500)
    assert np.allclose(whole, quality.term_vectors([text]))
    assert not quality.term_vectors([None, b"", b" \n"]).any()


# conversation trie

def sha(ids):
    return hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()


def trie_of(rebuilt):
    members = defaultdict(set)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, own in members.items():
        gain = (len(own) - 1) * len(SPACED.findall(p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += gain
    return [(min(own), len(p), min(members[p[:-1]]) if p else None, len(own), children[p], leaves[p], saved[p],
             sha([c for c in own if len(rebuilt[c]) == len(p)])) for p, own in members.items()]


def rebuilt_of(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
            convs[c].append((turn is not None, turn or 0, md5(md5(role) + md5(text)), role, text))
    convs = {c: [(x[3], x[4]) for x in sorted(v)] for c, v in convs.items()}
    out = {}
    for c, own in convs.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - int(np.fmod(c, 20))
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


CONVERSATIONS = "conv_id long, turn long, role string, text string, depth int, k1 int, own string, position int"


@pytest.mark.parametrize("height", [2, 3, 8])
def test_trie_of_rebuilt_conversations(spark, height):
    r = random.Random(height)
    rows = [(c, t, r.choice(["user", "assistant"]) if t else "user", r.choice(["a b", "c", "hello there you", ""])) for c in range(-30, 90) for t in range(r.randint(1, 9))]
    rows += [(200 + c, t, "user", "same words here") for c in range(60) for t in range(12)]  # a large group of equal conversations
    rows += [(500, None, None, None), (500, None, "user", "no turn"), (500, 3, "user", None), (501, 1, "a", "x"), (501, 1, "a", "x"), (501, 1, "b", "x"),
             (None, 1, "user", "nobody"), (None, None, None, None), (520, 0, "user", "w " * 20_000), (521, 0, "user", "w " * 20_000)]
    rows += [(600, t, "user", f"turn {t % 3}") for t in range(40)] + [(601, t, "user", f"turn {t % 3}") for t in range(37)]
    frame = spark.createDataFrame([(*x, 1, 2, "o", 3) for x in rows], CONVERSATIONS).repartition(5)
    same(turn_trie.rebuilt_trie(frame, height), trie_of(rebuilt_of(rows)))


def test_trie_of_a_very_long_conversation(spark):
    """Several runs of turns, several levels of bands."""
    rows = [(20 * c, t, "u", f"t{t % 5} and") for c, n in ((1, 3000), (2, 2990)) for t in range(n)]
    got = turn_trie.rebuilt_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    same(got, [(20, d, 20 if d else None, 2 if d <= 2990 else 1, int(d < 3000), 1, 2 * max(0, 2991 - max(d, 1)), sha([20] if d == 3000 else [40] if d == 2990 else []))
               for d in range(3001)])


def test_trie_without_conversations(spark):
    none = spark.createDataFrame([], CONVERSATIONS)
    assert turn_trie.rebuilt_trie(none).count() == 0
    assert turn_trie.rebuilt_trie(spark.createDataFrame([(None, 1, "u", "t", 1, 1, "", 1)], CONVERSATIONS)).count() == 0
    # a base of one turn leaves a conversation without turns: h is 3 for id 21, and its own turns go
    lone = next(c for c in range(20, 400, 20) if zlib.crc32(str(c + 1).encode()) % 4 == 3)
    rows = [(lone + 1, 0, "u", "gone")]
    same(turn_trie.rebuilt_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")),
         [(lone + 1, 0, None, 1, 0, 1, 0, sha([lone + 1]))])


def test_id_digests_over_several_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        ends = spark.range(0, 1000).selectExpr("IF(id < 900, 1, id) AS k1", "2L AS k2", "id * 3 - 50 AS conv_id").repartition(6)
        got = {r.k1: r.ends_sha256 for r in turn_trie.id_digests(ends).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {1: sha([i * 3 - 50 for i in range(900)])} | {i: sha([i * 3 - 50]) for i in range(900, 1000)}


# filter audit

def audit_of(docs, labels):
    """docs: (doc_id, text, lang)."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    ids = defaultdict(list)
    for d, t, _ in docs:
        ids[t or ""].append(d)
    fails = []
    for d, t, lang in docs:
        t = t or ""
        w = SPACED.findall(t)
        f = {"A"} if len(w) < 200 else set()
        f |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        f |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t) else set()
        f |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        f |= {"E"} if d is not None and any(o is not None and o < d for o in ids[t]) else set()
        fails.append((lang or "", d, f))
    out = []
    for part in {p for p, _, _ in fails}:
        mine = [(d, f) for p, d, f in fails if p == part]
        removed_by, rows = defaultdict(int), []
        for order in map("".join, permutations("ABCDE")):
            left, gone = mine, []
            for step, x in enumerate(order, 1):
                now = [(d, f) for d, f in left if x in f]
                redundant = sum(x in f for _, f in gone)
                left, gone = [(d, f) for d, f in left if x not in f], gone + now
                removed_by[x] += len(now)
                rows.append((part, order, step, len(left), len(now), redundant, sum(f == {x} for _, f in mine),
                             sum(d in good for d, _ in now), sum(d in toxic for d, _ in now)))
        out += [(*row, removed_by[row[1][row[2] - 1]]) for row in rows]
    return out


AUDITED = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


@pytest.mark.parametrize("most_cells", [1 << 28, 1 << 6])
def test_audit(spark, awkward, most_cells):
    r = random.Random(5)
    rows = [(x.doc_id, x.text, x.lang) for x in awkward.collect()]
    marks = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(-5, 30)] + [(1, 1, 0), (1, 0, 1), (None, 1, 1)]
    labels = spark.createDataFrame([(*m, 1, "x", 2) for m in marks], "doc_id long, quality int, toxic int, mask int, part string, n long")
    got = filter_audit.audit(awkward, labels, most_cells=most_cells)
    assert got.columns == AUDITED
    same(got, audit_of(rows, marks))


def test_audit_of_copies(spark):
    """A third of the rows are one text; ids repeat, are null, and come in any order."""
    texts = ["same text " * 120, "", None, "A B C", "x# " * 210, "one two three " * 100]
    r = random.Random(8)
    rows = [(r.choice([None, *range(60)]), r.choice(texts + texts[:1] * 3), r.choice(["en", "", None])) for _ in range(400)]
    rows += [(1000 + i, f"unique {i}", "de") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    marks = [(i, 1, i % 2) for i in range(0, 1200, 3)]
    same(filter_audit.audit(docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")), audit_of(rows, marks))


def test_audit_without_documents(spark, no_documents):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(no_documents, labels).count() == 0
    one = spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string")
    same(filter_audit.audit(one, labels.limit(0)), audit_of([(1, None, None)], []))


def test_sketch_clears_unique_texts_only(spark):
    texts = [f"text {i}" for i in range(5000)] + [f"text {i}" for i in range(0, 5000, 10)] + ["hot"] * 3000
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(9)
    cells = filter_audit.BLOCK * 2
    bits = filter_audit.repeat_sketch(docs, cells)
    def seen(t):
        probes = filter_audit.cells_of([hashlib.md5(t.encode()).digest()], cells)
        return bool((bits[probes >> 3] >> (7 - (probes & 7)).astype(np.uint8) & 1).all())
    assert all(seen(f"text {i}") for i in range(0, 5000, 10)) and seen("hot")
    assert sum(seen(f"text {i}") for i in range(5000) if i % 10) < 50
