"""Operators on documents against plain Python, over nulls, empty and long texts, copies, repeated rows and clashing columns."""

import re
import zlib

import numpy as np
import pytest
from awkward_texts import awkward_texts, prose
from brute import contamination, near_duplicates, near_links, repeats, same

from barline.llm import decontaminate, language, neardup, packing, repeats as dedup, shards, token_counts
from barline.llm.hashing import hashed_words, long_run_hashes, run_hashes, sliding
from barline.llm.tokens import encode, tokenizer_path

DOCS = awkward_texts()
ITEMS = [(1, prose(3, 12)), (2, prose(5, 10)), (3, "one"), (4, None), (5, "..."), (6, prose(1, 30)), (6, prose(1, 30)), (None, prose(4, 11)), (7, prose(99, 40))]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def ids(frame):
    return sorted((r.doc_id for r in frame.collect()), key=lambda x: (x is None, x or 0))


@pytest.mark.parametrize("held", [1 << 20, 300])  # in one pass, and in several
def test_contamination(awkward, items, held):
    same(decontaminate.contamination(awkward, items, broadcast_bytes=held), contamination(DOCS, ITEMS))


def test_decontaminate_drops_documents_or_spans(awkward, items):
    judged = contamination(DOCS, ITEMS)
    kept = decontaminate.decontaminate(awkward, items)
    assert kept.columns == awkward.columns
    assert ids(kept) == sorted((r[0] for r in judged if not r[-1]), key=lambda x: (x is None, x or 0))
    cut = decontaminate.decontaminate(awkward, items, action="spans")
    assert cut.columns == awkward.columns and cut.count() == len(DOCS)
    left = [(r.doc_id, r.text) for r in cut.collect()]
    clean = {t for (_, t), r in zip(DOCS, judged) if not r[-1]}
    assert clean <= {t for _, t in left}
    assert all(prose(1, 30) not in (t or "") for _, t in left)
    with pytest.raises(ValueError):
        decontaminate.decontaminate(awkward, items, action="nothing")


def test_decontaminate_empty(awkward, items, no_documents):
    assert decontaminate.contamination(no_documents, items).count() == 0
    same(decontaminate.contamination(awkward, items.limit(0)), contamination(DOCS, []))


@pytest.mark.parametrize("rows_in_part", [20_000, 3])
def test_interleave(awkward, rows_in_part):
    from collections import Counter

    rows = shards.interleave(awkward, rows_in_part=rows_in_part).collect()
    expected = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in DOCS)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == expected
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    assert rows == shards.interleave(awkward.repartition(5), rows_in_part=7).collect() or Counter(rows) == Counter(
        shards.interleave(awkward.repartition(5), rows_in_part=7).collect())


def test_interleave_mixture_and_repeated_rows(spark):
    rows = [(i, f"t{i}", "big" if i % 4 else "small") for i in range(4000)] + [(7, "same", "big")] * 2000
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = shards.interleave(docs, rows_in_part=100).toPandas()
    assert len(got) == 6000
    share = got.groupby("shard").source.value_counts().unstack()
    assert (share.max() - share.min()).max() <= 1


def test_interleave_empty(no_documents):
    assert shards.interleave(no_documents).count() == 0


@pytest.mark.parametrize("length", [1024, 7])
def test_pack_round_trip(awkward, length):
    from collections import defaultdict

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    rows = packing.pack(awkward, length).collect()
    stream = np.concatenate([np.frombuffer(r.ids, np.uint16) for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset))])
    assert all(zlib.crc32(np.frombuffer(r.ids, np.uint16).astype("<u4")) == r.ids_crc32 and len(r.ids) == 2 * r.length for r in rows)
    by_sequence = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.offset):
        by_sequence[r.sequence_id].append(r)
    for k, pieces in by_sequence.items():
        ends = [p.offset + p.length for p in pieces]
        assert [p.offset for p in pieces] == [0, *ends[:-1]]
        assert ends[-1] == length or k == max(by_sequence)
    whole = [r for r in rows if r.start == 0]
    assert len(whole) == len(DOCS)
    expected = sorted(tuple(tokenizer.encode(t or "", add_special_tokens=False).ids) + (0,) for _, t in DOCS)
    got = sorted(tuple(stream[r.sequence_id * length + r.offset:][:r.doc_tokens].tolist()) for r in whole)
    assert got == expected


def test_pack_empty(no_documents):
    assert packing.pack(no_documents).count() == 0


def test_encode_equals_the_public_library():
    import random

    from tokenizers import Tokenizer

    tokenizer, path, r = Tokenizer.from_file(tokenizer_path()), tokenizer_path(), random.Random(5)
    letters = "ab  \n\t'sx1²é ßж中\x1c\x85\xa0 .,!?\x00🙂"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    texts += ["a <|endoftext|> it's", "<|endoftext|><|endoftext|>", "word " * 70_000, "don't stop, he said " * 20_000]
    for text in texts:
        assert encode(text, path) == tokenizer.encode(text, add_special_tokens=False).ids


def test_encode_long_runs_of_white_space():
    from tokenizers import Tokenizer

    tokenizer, path = Tokenizer.from_file(tokenizer_path()), tokenizer_path()
    run = 2_000_000
    for text in ["a" + " " * run + "b", "a" + "\n" * run + "b", "word " * 60_000 + " \n" * run + "<|endoftext|> end, " * 20_000 + " " * run, "a" + "\x1c \x85" * 50_000 + "b"]:
        assert encode(text, path) == tokenizer.encode(text, add_special_tokens=False).ids


def test_pack_and_count_long_runs_of_white_space(spark):
    docs = spark.createDataFrame([(1, "a" + " " * 2_000_000 + "b"), (2, "c")], "doc_id long, text string")
    sizes = sorted(len(encode(t, tokenizer_path())) for t in ("a" + " " * 2_000_000 + "b", "c"))
    assert sorted(r.n_tokens for r in token_counts.corpus_token_counts(docs).collect()) == sizes
    assert sorted({(r.doc_id, r.doc_tokens) for r in packing.pack(docs, with_ids=False).collect()}) == [(1, sizes[1] + 1), (2, sizes[0] + 1)]


@pytest.mark.parametrize("block", [8, 1 << 20])
def test_token_counts(spark, awkward, block, tmp_path):
    path = f"{tmp_path}/flat"
    token_counts.write_flat(awkward.orderBy("row").coalesce(2), path)
    rows = token_counts.count_tokens(token_counts.flat_blocks(spark, path, block), block).collect()
    assert all(r.ended for r in rows)
    vocabulary = tokenizer_path()
    got = [r.n_tokens for r in sorted(rows, key=lambda r: (r.file, r.doc_index))]
    expected = [len(encode(t or "", vocabulary)) for _, t in DOCS]
    assert sorted(got) == sorted(expected)
    for f in {r.file for r in rows}:
        own = sorted((r for r in rows if r.file == f), key=lambda r: r.doc_index)
        assert [r.doc_index for r in own] == list(range(len(own)))
        assert all(b.start == a.start + a.n_tokens + 1 for a, b in zip(own, own[1:])) and own[0].start == 0


def test_token_counts_unended_file(spark, tmp_path):
    np.array([5, 6, 0, 0, 7] + [8] * 20, np.uint16).tofile(tmp_path / "a.bin")
    np.array([3, 0], np.uint16).tofile(tmp_path / "b.bin")
    (tmp_path / "c.bin").touch()
    rows = token_counts.count_tokens(token_counts.flat_blocks(spark, str(tmp_path), 4), 4)
    same(rows, [("a.bin", 0, 0, 2, True), ("a.bin", 1, 3, 0, True), ("a.bin", 2, 4, 21, False), ("b.bin", 0, 0, 1, True)])


def test_token_counts_empty(no_documents):
    assert token_counts.corpus_token_counts(no_documents).count() == 0


def test_near_duplicates(awkward):
    same(neardup.duplicate_classes(awkward), near_duplicates(DOCS))


@pytest.mark.parametrize("block", [8, 800])
def test_near_duplicates_large_group(spark, block):
    import random

    r, base = random.Random(3), prose(50, 150).split()
    docs = []
    for i in range(120):
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = f"new{r.randint(0, 9)}"
        docs.append((i, " ".join(w)))
    docs += [(1000 + i, docs[0][1]) for i in range(40)] + [(2000 + i, prose(60 + i, 80)) for i in range(30)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    same(neardup.duplicate_classes(frame, block=block), near_duplicates(docs))


@pytest.mark.parametrize("block", [8, 800])
def test_near_duplicates_of_repeated_rows(spark, block):
    """Repeated rows, with and without id, in a group of different texts."""
    base = prose(80, 150)
    texts = [base]
    for k in range(30):
        w = base.split()
        w[5 * k] = f"new{k}"
        texts.append(" ".join(w))
    docs = [(k, t) for k, t in enumerate(texts)] + [(0, base)] * 3 + [(7, texts[7])] * 5 + [(None, texts[9])] * 2 + [(None, prose(81, 90) + " end")] * 4
    docs += [(500, prose(81, 90) + " stop"), (600, prose(82, 60)), (600, prose(82, 60))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    same(neardup.duplicate_classes(frame, block=block), near_duplicates(docs))
    kept = sorted(r.doc_id for r in neardup.keep_one(frame, block=block).collect())
    assert kept == [0, 500, 600]


def test_keep_one(awkward, no_documents):
    kept = neardup.keep_one(awkward)
    assert kept.columns == awkward.columns
    has_words = [bool(re.search(r"[0-9A-Za-z\x80-\U0010ffff]", t or "")) for _, t in DOCS]
    by_class = {}
    for doc, root, worded in zip(DOCS, near_links(DOCS)[1], has_words):
        if worded:
            by_class.setdefault(root, []).append(doc)
    expected = [min(v, key=lambda x: (x[0] is None, x[0] or 0)) for v in by_class.values()]
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(d or 0 for d, t in got if (d, t) in expected) == sorted(d or 0 for d, _ in expected)
    assert len(got) == len(expected) + has_words.count(False)
    assert neardup.keep_one(no_documents).count() == 0
    assert neardup.duplicate_classes(no_documents).count() == 0


def test_bands_reach_the_recall():
    bands, rows = neardup.bands_and_rows(0.8, 0.9999)
    assert (bands, rows) == (25, 5) and 1 - (1 - 0.8**rows) ** bands >= 0.9999
    with pytest.raises(ValueError):
        neardup.bands_and_rows(0.1, 0.999999, 16)


def test_repeats(awkward, no_documents):
    same(dedup.removal_report(awkward), repeats(DOCS))
    same(dedup.removal_report(awkward, window=12, phrase=5), repeats(DOCS, 12))
    assert dedup.removal_report(no_documents).count() == 0


def test_repeats_of_one_passage_in_most_documents(spark):
    passage = prose(70, 64)
    docs = [(i, f"{prose(100 + i, 20)} {passage} {prose(300 + i, i % 90)}") for i in range(150)]
    same(dedup.removal_report(spark.createDataFrame(docs, "doc_id long, text string")), repeats(docs))


@pytest.mark.parametrize("patterns,streamed", [(1 << 15, 4 << 20), (3, 400)])
def test_repeats_of_repeated_rows_and_shards(spark, patterns, streamed):
    """Repeated rows inside a recurring passage, several automata, several parts of a shard's documents."""
    passage, second = prose(70, 64), prose(71, 90)
    docs = [(1, f"{prose(72, 30)} {passage}")] * 60 + [(2, f"{passage} {prose(73, 30)}")] * 80 + [(2, f"{second} {passage}")] * 3
    docs += [(100 + i, f"{prose(100 + i, 20)} {passage if i % 2 else second} {prose(300 + i, i % 90)}") for i in range(40)]
    docs += [(500, second)] * 5 + [(None, passage)] * 2 + [(501, second), (3, prose(74, 200)), (4, prose(74, 199))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    same(dedup.removal_report(frame, patterns=patterns, streamed=streamed), repeats(docs))
    found = dedup.Repeats(frame, patterns=patterns, streamed=streamed)
    assert found.candidates.count() == found.candidates.select("row").distinct().count() < 50


def test_phrase_automaton_locates_every_occurrence(monkeypatch):
    r = np.random.default_rng(6)
    codes = r.integers(0, 4, 3000).astype(np.uint32)
    wanted = {tuple(codes[i:i + 5].tolist()) for i in range(0, 3000, 50)}
    expected = [i for i in range(2996) if tuple(codes[i:i + 5].tolist()) in wanted]
    for chunk in (1 << 16, 7):
        monkeypatch.setattr(dedup, "CHUNK", chunk)
        automaton = dedup.PhraseAutomaton(5)
        assert not len(automaton.places(codes))
        automaton.add(np.array(sorted(wanted), np.uint32).tobytes())
        assert automaton.places(codes).tolist() == expected


def test_kept_words():
    r = np.random.default_rng(7)
    for _ in range(300):
        text = b"".join(r.choice([b"a", b"bc", b" ", b"\n", b"\t ", "é".encode()], r.integers(0, 30)).tolist())
        words = text.split()
        starts = sorted({int(x) for x in r.integers(0, max(len(words) - 2, 1), r.integers(0, 3))}) if len(words) >= 3 else []
        gone = {i + k for i in starts for k in range(3)}
        assert dedup.kept_words(text, starts, 3) == (len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone))


def test_remove_repeats(awkward):
    report = {}
    for d, n, removed, digest in repeats(DOCS):
        report.setdefault(d, []).append((n, removed, digest))
    got = dedup.remove_repeats(awkward)
    assert got.columns == awkward.columns
    rows = got.collect()
    gone = sum(1 for v in report.values() for n, removed, _ in v if removed and removed == n)
    assert len(rows) == len(DOCS) - gone
    texts = {(d, t) for d, t in DOCS}
    for r in rows:
        if (r.doc_id, r.text) not in texts:
            from brute import sha

            assert sha(r.text) in {digest for _, removed, digest in report[r.doc_id] if removed} and r.n_chars == len(r.text)


def test_hashes_tell_words_apart():
    texts = [b"a b", b"", None, b"ab a\x00 \x00a " + b"y" * 5_000_000, b"b a"]
    words, bounds = hashed_words(texts, fold=False)
    assert bounds.tolist() == [0, 2, 2, 2, 6, 8]
    assert words[0] == words[7] and words[1] == words[6] and len(set(words.tolist())) == 6
    x = np.random.default_rng(1).integers(0, 2**63, 5000, np.uint64)
    x[3000:3100] = x[100:200]
    a, b = run_hashes(x, 5), long_run_hashes(x, 50, np.uint64(12345677))
    assert (a[3000:3096] == a[100:196]).all() and (b[3000:3051] == b[100:151]).all() and len(np.unique(b)) == len(b) - 51
    assert (sliding(x, 43, np.minimum) == [x[i:i + 43].min() for i in range(len(x) - 42)]).all()


SYLLABLES = {"en": "the and ing ly with of".split(), "de": "der und ung lich mit sch".split(), "fr": "le eau tion que pour oi".split(),
             "es": "el ado cion que para os".split(), "xx": "kwa mbi zu nga tu li".split()}


def invented(lang, seed, n):
    import random

    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


def test_language_held_out_accuracy(spark):
    docs = [(i, invented(lang, i, 5 + i % 40), lang) for i, lang in enumerate(list(SYLLABLES) * 120)]
    odd = [(9001, None, "en"), (9002, "", "en"), (9003, "12 ² 34 !", "de"), (None, invented("fr", 1, 20), "fr"), (9004, invented("de", 3, 20), None)]
    frame = spark.createDataFrame(docs + odd, "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "'c' AS lang_pred")
    rows = {r.doc_id: r for r in language.identify(frame).collect()}
    assert len(rows) == len(docs) + len(odd)
    held = [i for i, *_ in docs if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(rows[i].held_out == (i in set(held)) for i, *_ in docs) and not rows[None].held_out
    right = sum(rows[i].lang_pred == lang for i, _, lang in docs if i in set(held))
    assert right >= 0.97 * len(held)
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (9001, 9002, 9003))
    assert rows[9004].lang_pred == "de" and rows[None].lang_pred == "fr" and all(0 <= r.score <= 1 for r in rows.values())
    kept = language.keep_identified(frame)
    assert kept.columns == frame.columns and kept.count() == len(docs) + 2


def test_language_without_labels(awkward, no_documents):
    none = awkward.withColumn("lang", awkward.lang.substr(99, 1)).selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")
    assert {(r.lang_pred, r.score) for r in language.identify(none).collect()} == {("und", 0.0)}
    assert language.identify(no_documents).count() == 0
    assert language.identify(awkward).count() == len(DOCS)
