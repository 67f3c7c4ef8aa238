"""The corpus operators against plain versions, on small tables with the odd cases."""

import base64
import hashlib
import io
import os
import random
import struct
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark import TaskContext
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))

import brute  # noqa: E402

from changetide.llm import ann, bpe, chat, chunks, components, langid, minhash, mixing, pii, quality, queries, warc, words  # noqa: E402

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"wort{i % 977}" for i in range(30_000))


def docs_of(spark, rows):
    """Rows (doc_id, text[, lang[, source]]), with columns whose names the operators use themselves."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a", None) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    return df.withColumns({c: F.lit("own") for c in ("key", "rep", "size", "kind", "start", "score", "h1", "ids", "part", "run")})


def prose(rng, n, alphabet="abcdefghij"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 8))) for _ in range(n))


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "word"), (5, "A b"), (None, "no id at all here"), (6, LONG), (7, "é\u0000ß x 中文"), (7, "é\u0000ß x 中文")]


# BPE


@pytest.fixture(scope="module")
def encoder():
    return bpe.encoder(bpe.read_ranks(public_tokenizers.path(queries.RANKS)))


@pytest.fixture(scope="module")
def plain_encoder(encoder):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})


def test_bpe_equals_rank_order_merging(encoder, plain_encoder):
    rng, split = random.Random(1), bpe.splitter(public_tokenizers.PATTERN)
    pools = ["aeiou thn", "\n\t 　\x85\x1c​", "日本語한국어العربية", "'sstrevemlld 123½²ⅧS’", "-_*#😀‍", "aaaaaaa", "heitschlich ung"]
    texts = ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(0, 80))) for _ in range(3000)] + [LONG, "x" * 5000, ""]
    for text in texts:
        ids = encoder.encode(split(text))
        assert ids == plain_encoder.encode_ordinary(text)
        assert encoder.decode(ids) == text.encode()


def test_bpe_where_a_longest_match_must_be_given_up():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"bc": 257, b"cd": 258, b"abc": 259, b"bcd": 260, b"aa": 261, b"aab": 262}
    own = bpe.Encoder(ranks)
    rng = random.Random(2)
    for _ in range(3000):
        data = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 12))).encode()
        want = [ranks[data]] if data in ranks else [ranks[p] for p in bpe.merged(data, ranks, 10**9)]
        assert list(own.piece(data)) == want


def test_bpe_rows(spark, plain_encoder):
    rows = bpe.round_trip(docs_of(spark, ODD), public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN).collect()
    assert len(rows) == len(ODD)
    want = sorted(
        (str(i), len(ids := plain_encoder.encode_ordinary(t or "")), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
         hashlib.sha256((t or "").encode()).hexdigest())
        for i, t in ODD
    )
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want
    ids = bpe.tokens(docs_of(spark, ODD[:5]), public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN).collect()
    assert {r.doc_id: r.ids for r in ids}[4] == plain_encoder.encode_ordinary("word")
    assert bpe.round_trip(docs_of(spark, ODD).limit(0), public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN).count() == 0


# MinHash


def near_rows(seed=3, n=60, hub=False):
    rng, rows = random.Random(seed), []
    for i in range(n):
        text = prose(rng, rng.randint(20, 90))
        rows.append((10 * i, text))
        for j in range(rng.choice((0, 0, 1, 3))):
            w = text.split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"new{rng.randrange(99)}"
            rows.append((10 * i + 1 + j, " ".join(w)))
    base = prose(rng, 200).split()
    for i in range(80):  # copies of one text that are seldom near enough to each other
        w = list(base)
        for _ in range(4):
            w[rng.randrange(len(w))] = f"own{i}"
        rows.append((5000 + i, " ".join(w)))
    if hub:
        rows.append((9000, " ".join(base)))
    return rows


@pytest.mark.parametrize("hub", [False, True])
def test_near_duplicates(spark, hub):
    rows = near_rows(hub=hub)
    got = minhash.near_duplicates(docs_of(spark, rows)).collect()
    want = brute.near_duplicates(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_odd_rows(spark):
    rows = [*ODD, (8, "A B"), (9, "a  b\n"), (10, None)]
    got = minhash.near_duplicates(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None}
    assert found[1] == (0, 1, True) and found[2] == (0, 2, True) and found[3] == (0, 3, True)
    assert found[5] == (1, 5, True) and found[8] == (1, 5, False) and found[9] == (1, 5, False)
    assert found[6] == (977, 6, True) and found[7][1:] == (7, True)
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert minhash.near_duplicates(docs_of(spark, rows).limit(0)).count() == 0


def test_rows_of_one_id_with_different_texts(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "q w e r t z"), (3, "q w e r t z"), (4, "z z z z z")]
    got = minhash.near_duplicates(docs_of(spark, rows)).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_pieces_estimate_similarity():
    factors, shifts = minhash._draws(400, 1)
    a, b = (np.unique(words.mixed(np.arange(i, i + 1000, dtype=np.uint64))) for i in (0, 200))
    same = np.mean(minhash.pieces(a, factors, shifts, 1) == minhash.pieces(b, factors, shifts, 1))
    assert abs(same - 800 / 1200) < 0.08


def test_odd_sketches_never_differ_by_more_than_the_sets():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(1, 3000))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.random()], rng.integers(0, 2**63, n // 3).astype(np.uint64)]))
        differ = sum(int(x).bit_count() for x in (minhash.odd_sketch(a) ^ minhash.odd_sketch(b)).view(np.uint64))
        assert differ <= len(np.setxor1d(a, b))


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7), (None, 3)]
    parent = list(range(500))

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for a, b in edges:
        if a is not None:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = components.components(spark.createDataFrame(edges, "x long, y long")).collect()
    assert {r.node: r.root for r in got} == {i: root(i) for i in range(500) if root(i) != i}


# PII


TEXTS = [
    "a@b.c_d@e.f x@y a@b@c.d .z@1.2. q@-.-",
    "1.2.3.4.5 999.1.1.1 01.002.255.0255 1.2.3 10.0.0.1",
    "4111 1111 1111 1111 4111111111111112 12 1 2--3 4111-1111-1111-1111- 0 " + "9" * 25,
    "+1 (017) 555-7713 +12 +1234567890123456 ++49 30 1234567. +1.2.3 (+44-20-7946-0958)",
    "é😀 a@b.cc ñ 4111111111111111 +49 30 12345678 1.1.1.1 a@b.cc",
    None, "", " ", "a" * 20000, "1" * 5000, "1." * 3000, "a@" * 500, "+1" * 500,
]


def test_base_spans(spark):
    rng = random.Random(6)
    texts = TEXTS + ["".join(rng.choice("a1 2.@-+()4_é%") for _ in range(rng.randint(0, 60))) for _ in range(800)]
    docs = docs_of(spark, list(enumerate(texts)) + [(0, texts[0])])
    rows = pii.per_document(docs, pii.findings(docs)).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        want = brute.base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), texts[r.doc_id]
        counts = [sum(w.startswith(k + ":") for w in want) for k in pii.KINDS]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts
        assert [s for s in r.spans.split(",") if s and not s.startswith("context")] == want


def test_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"they wrote to Contact: user{i}@mail.org the next day and the day after") for i in range(8)]
    rows += [(100 + i, f"someone said Contact: ZX-{7000 + i}-QQ the {1990 + i} report") for i in range(3)]
    rows += [(200 + i, f"in {1950 + i} the 12345{i} sheep and the cows ate the grass of {1800 + i}") for i in range(20)]
    rows += [(300, "elsewhere ZX-7001-QQ stands alone")]
    docs = docs_of(spark, rows)
    spans = pii.findings(docs)
    found = {r.doc_id: r for r in pii.per_document(docs, spans).collect()}
    assert [found[100 + i].n_context for i in range(3)] == [1, 1, 1]
    assert found[100].spans == f"context:{rows[8][1].index('ZX')}:{rows[8][1].index('ZX') + 10}"
    assert found[300].n_context == 1
    assert not any(found[200 + i].spans for i in range(20)) and all(found[i].n_email == 1 for i in range(8))
    clean = {r.doc_id: r.text for r in pii.redacted(docs, spans).collect()}
    assert clean[0] == "they wrote to Contact: [EMAIL] the next day and the day after"
    assert clean[100] == "someone said Contact: [CONTEXT] the 1990 report"
    assert clean[200] == rows[11][1]


def test_redaction_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a@b.c"), (4, "x é 1.2.3.4@b.cc y +49 30 1234567 z"), (4, "x é 1.2.3.4@b.cc y +49 30 1234567 z"), (None, "a@b.c")]
    docs = docs_of(spark, rows)
    got = pii.redacted(docs, pii.findings(docs))
    assert got.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in got.collect()) == sorted(
        [("1", "None"), ("2", ""), ("3", "[EMAIL]"), ("4", "x é [EMAIL] y [PHONE] z"), ("4", "x é [EMAIL] y [PHONE] z"), ("None", "[EMAIL]")]
    )
    empty = docs.limit(0)
    assert pii.per_document(empty, pii.findings(empty)).count() == 0


# language


def lang_rows(n=300):
    rng, rows = random.Random(7), []
    for i in range(n):
        lang = ("aa", "bb", "cc")[i % 3]
        alphabet = {"aa": "abcdeé", "bb": "fghijß", "cc": "klmnoñ"}[lang]
        rows.append((i, prose(rng, rng.randint(3, 40), alphabet), lang))
    return rows


def test_language(spark):
    rows = lang_rows() + [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 34 !", "bb"), (1003, "abc", None), (None, "fgh", "bb")]
    docs = docs_of(spark, rows)
    model = langid.train(docs, max_rows=200)
    got = langid.identified(docs, model).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in rows}
    import zlib

    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    held = [r for r in got if r.held_out and r.doc_id < 1000]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id in (1000, 1001, 1002)} == {1000: "und", 1001: "und", 1002: "und"}
    assert sorted(model.languages) == ["aa", "bb", "cc"] and (model.weights == 0).mean() > 0.5
    again = langid.train(docs.repartition(7), max_rows=200)
    assert np.array_equal(model.weights, again.weights) and model.temperature == again.temperature
    kept = langid.accepted(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id in (1000, 1001, 1002)").count() == 0
    assert langid.identified(docs.limit(0), langid.train(docs.limit(0))).count() == 0


def test_the_sample_stays_off_the_driver(spark, monkeypatch):
    rows = lang_rows(150)
    docs = docs_of(spark, rows).repartition(5)
    sample = sorted(
        (r.hash, r.lang, langid.counts(r.text))
        for r in docs.where(~langid.held_out("doc_id")).withColumn("hash", F.xxhash64("text")).collect()
    )
    total = sum((c > 0).astype(np.int64) for _, _, c in sample)
    idf = np.log((1 + len(sample)) / (1 + total)) + 1
    data = [(lang, np.flatnonzero(c), c[np.flatnonzero(c)]) for _, lang, c in sample]
    plain = langid.fit(data, ["aa", "bb", "cc"], idf, 4, 0.5, 0.02, 0.01)

    def in_a_task(*args, fit=langid.fit):
        assert TaskContext.get() is not None, "the driver learns from the sample"
        return fit(*args)

    monkeypatch.setattr(langid, "fit", in_a_task)
    model = langid.train(docs)
    assert model.languages == plain.languages and model.temperature == plain.temperature
    assert np.array_equal(model.weights, plain.weights) and np.array_equal(model.bias, plain.bias)
    assert langid.identified(docs, model).count() == len(rows)


def test_held_out_rows_teach_nothing(spark):
    rows = lang_rows(120)
    docs = docs_of(spark, rows)
    changed = docs.withColumn("lang", F.when(langid.held_out("doc_id"), F.lit("zz")).otherwise(F.col("lang")))
    changed = changed.withColumn("text", F.when(langid.held_out("doc_id"), F.lit("zz")).otherwise(F.col("text")))
    a, b = langid.train(docs), langid.train(changed)
    assert a.languages == b.languages and np.array_equal(a.weights, b.weights) and np.array_equal(a.idf, b.idf)


def test_copies_take_no_place_in_the_sample(spark):
    copied = [prose(random.Random(i), 25, "stuvwxyz") for i in range(20)]
    rows = [r for r in lang_rows() if r[2] != "cc"]
    rows += [(5000 + i, copied[i % 20], "cc") for i in range(6000)]
    learnt = [i for i in range(20_000, 20_200) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows += [(learnt[0], prose(random.Random(77), 30, "\u0431\u0432\u0433\u0434"), "dd")]  # its only text
    rows += [(learnt[1 + i], "12 34", "ee") for i in range(20)]  # nothing to learn
    docs = docs_of(spark, rows).repartition(8)
    model = langid.train(docs, max_rows=80)
    assert model.languages == ["aa", "bb", "cc", "dd"]
    got = langid.identified(docs.where("lang = 'cc'").limit(200), model).collect()
    assert np.mean([r.lang_pred == "cc" for r in got]) > 0.97


def test_rare_languages_are_learned(spark):
    ids = [i for i in range(800) if zlib.crc32(str(i).encode()) % 4 != 2][:510]
    docs = docs_of(spark, [(i, prose(random.Random(i), 10), f"l{i}") for i in ids])
    assert langid.train(docs, epochs=1).languages == sorted(f"l{i}" for i in ids)


def test_calibration_and_slices():
    rng = np.random.default_rng(1)
    logits = rng.normal(size=(4000, 3)) * 2
    labels = np.array([rng.choice(3, p=p) for p in langid.softmax(logits)])
    assert abs(langid.calibrated(logits * 5, labels) - 5) < 0.6
    assert langid.counts("ab" * (langid.SLICE // 2 + 10)).sum() > langid.SLICE
    assert langid.counts("1 2") is None and langid.counts(None) is None


# mixing


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN_ROWS", 20)
    monkeypatch.setattr(mixing, "FAN_IN", 2)
    rng, rows = random.Random(8), []
    for i in range(400):
        source = rng.choice(["a", "a", "a", "b", "é", "z", None, ""])
        rows.append((i, " ".join("w" * rng.randint(0, 30)), "en", source))
    rows += [(500, None, "en", "a"), (501, "", "en", "only empty"), (7, rows[7][1], "en", rows[7][3])]
    docs = docs_of(spark, rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes, taken, target = {}, {}, {}
    by_id = {r[0]: r[3] for r in rows}
    for r in got:
        s = by_id[r.doc_id]
        assert 0 <= r.copies <= 2 and r.taken == r.copies * r.size
        sizes[s], taken[s], target[s] = sizes.get(s, 0) + r.size, taken.get(s, 0) + r.taken, r.target
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_names, want = 1.5 * sum(sizes.values()), set(names), {}
    while True:
        share = {s: left * weights[s] / sum(weights[t] for t in open_names) for s in open_names}
        full = [s for s in open_names if share[s] > 2 * sizes[s]]
        if not full:
            want |= share
            break
        for s in full:
            want[s] = 2 * sizes[s]
            left -= want[s]
            open_names.remove(s)
    for s in names:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 30
        assert sizes[s] in {r.source_size for r in got if by_id[r.doc_id] == s}
    again = mixing.mix(docs.repartition(5)).collect()
    key = lambda r: (r.doc_id, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    assert mixed.where("doc_id < 400 and doc_id <> 7").count() == sum(r.copies for r in got if r.doc_id < 400 and r.doc_id != 7)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_settling_keeps_words_and_expectations():
    rng = random.Random(9)
    rows = [(i, i, rng.randint(1, 40), rng.random()) for i in range(60)]
    total = sum(r[2] * r[3] for r in rows)
    sums = np.zeros(60)
    for seed in range(400):
        done = mixing.settle(rows, seed, 0)
        assert len(done) == 60 and sum(0 < d[3] < 1 for d in done) <= 1
        assert sum(d[2] * d[3] for d in done) == pytest.approx(total)
        for d in done:
            sums[d[0]] += d[3]
    assert np.abs(sums / 400 - [r[3] for r in rows]).max() < 0.12


# WARC


def test_warc(spark, tmp_path):
    html = ["<p>a</p>", "", None, "<p>a</p>", "é" * 5000, "x", "x", "x"]
    rows = [(10 - i, f"http://h/{i} \n", h) for i, h in enumerate(html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit(1))
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archived(pages).collect()}
    assert got == brute.warc([(r[0], r[2]) for r in rows])
    archives = warc.write(pages, str(tmp_path), min_bytes=2)
    back = {r.page_id: r for r in warc.read(archives).collect()}
    assert [back[5].record_type, back[3].record_type, back[7].record_type, back[10].refers_to] == ["response", "response", "response", 7]
    assert bytes(back[6].payload).decode() == html[4] and back[6].url == "http://h/4%20%0A"
    odd = spark.createDataFrame([(None, None, "same"), (3, None, "same"), (3, None, "same"), (4, "u", "same")], "page_id long, url string, html string")
    found = sorted((str(r.page_id), r.record_type, r.refers_to) for r in warc.archived(odd).collect())
    assert found == [("3", "response", None), ("3", "response", None), ("4", "revisit", 3), ("None", "revisit", 3)]
    assert warc.archived(pages.limit(0)).count() == 0


def archive(dictionary=b"", packed=True, **changes):
    bodies = [f"<html>{i} some words of a page {i * i}</html>".encode() * 3 for i in range(300)]
    dictionary = warc.trained(bodies, 2048) if dictionary is None else dictionary
    options = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    encoder = zstandard.ZstdCompressor(write_checksum=True, **options)
    lead = warc.leading_frame(dictionary)
    if dictionary and not packed:
        lead = struct.pack("<II", warc.DICTIONARY_MAGIC, len(dictionary)) + dictionary
    records = [warc.record(i, None, b, None, False, len(b), warc.digest(b)) for i, b in enumerate(bodies)]
    return lead + b"".join(encoder.compress(r) for r in records), bodies


@pytest.mark.parametrize("dictionary", [b"", None])
@pytest.mark.parametrize("packed", [True, False])
def test_archives_with_and_without_a_dictionary(dictionary, packed):
    data, bodies = archive(dictionary, packed)
    found = list(warc.records(io.BytesIO(data)))
    assert [f["payload"] for f in found] == bodies and [f["page_id"] for f in found] == list(range(300))
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(data[:-3])))


def test_wrong_records_are_refused():
    body = b"<p>x</p>"
    good = warc.record(1, "u", body, None, False, len(body), warc.digest(body))
    assert warc.parsed(good)["payload"] == body
    for old, new in ((b"WARC/1.1", b"WARC/9.9"), (b"<p>x", b"<p>y"), (b"Content-Length: 8", b"Content-Length: 9"), (b"WARC-Type: response", b"WARC-Type: other"),
                     (b"WARC-Date", b"WARC-Type"), (b"\r\n\r\n", b"\r\n"), (b"WARC-Type: response", b"WARC-Type: revisit"), (b"sha1:", b"md5:")):
        with pytest.raises(ValueError):
            warc.parsed(good.replace(old, new))
    with pytest.raises(ValueError):
        warc.parsed(good + b"x")


# nearest neighbours


def test_nearest_on_lists(spark):
    rng = np.random.default_rng(10)
    centers = rng.normal(size=(20, 24))
    x = (centers[rng.integers(0, 20, 3000)] + 0.3 * rng.normal(size=(3000, 24))).astype(np.float32)
    x[1000:2000] = x[0] + 0.01 * rng.normal(size=(1000, 24))  # one hot list
    rows = [(i, x[i].tolist()) for i in range(3000)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.nearest(frame, F.col("id") % 100 == 0).collect()
    want = brute.nearest([(i, x[i]) for i in range(3000)], range(0, 3000, 100))
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert all(len(v) == 10 and v == sorted(v, key=lambda p: (p[1], p[0])) for v in found.values())
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / 300 >= 0.9
    exact = dict(rows)
    for q, near in found.items():
        for i, s in near:
            assert s == pytest.approx(np.linalg.norm(np.array(exact[q], float) - np.array(exact[i], float)), rel=1e-12)


def test_nearest_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]),
            (7, [1.0, 1.0]), (8, [1.0, 1.0]), (8, [1.0, 1.0]), (None, [1.0, 2.0]), (9, [1.0, 2.0, 3.0]), (200, None), (0, [1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("own"))
    got = sorted(map(tuple, ann.nearest(frame, F.col("id") % 100 == 0).collect()))
    assert [(q, r, v) for q, r, v, _ in got] == [(0, 1, 7), (0, 2, 8), (0, 3, 100), (100, 1, 7), (100, 2, 8), (100, 3, 0)]
    assert ann.nearest(frame.limit(0), F.col("id") % 100 == 0).count() == 0
    assert ann.nearest(frame.where("vec_id = 0"), F.col("id") % 100 == 0).count() == 0


# chunks


def test_nearest_on_clusters_and_copies(spark):
    rng = np.random.default_rng(8)
    tight = [rng.normal(size=16) * 10 for _ in range(3)]
    far = [rng.normal(size=16) * 100 for _ in range(24)]  # groups of few rows: less than k in a list
    vectors = [tight[i % 3] + rng.normal(size=16) * 0.01 for i in range(3000)]
    vectors += [tight[0]] * 1500  # copies
    vectors += [far[i % 24] + rng.normal(size=16) * 0.01 for i in range(96)]
    ids = [i for i in range(20_000) if i % 100][: len(vectors)]
    asked = [0, 1000, 2000, *range(3000, 3005), *range(4500, 4596, 4)]  # dense, copies and scattered ones
    for n, i in enumerate(asked):
        ids[i] = 100 * (n + 1)
    vectors = np.array(vectors)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, vectors)], "vec_id long, embedding array<double>")
    found: dict = {}
    for r in ann.nearest(frame, F.col("id") % 100 == 0).collect():
        found.setdefault(r.query_id, []).append(r.score)
    assert {q: len(v) for q, v in found.items()} == {ids[i]: 10 for i in asked}
    near = []
    for i in asked:
        exact = np.sort(np.delete(np.sqrt(((vectors - vectors[i]) ** 2).sum(1)), i))[:10]
        near += [a <= b + 1e-9 for a, b in zip(sorted(found[ids[i]]), exact)]
    assert np.mean(near) > 0.9


def test_nearest_of_a_row_alone_in_its_list(spark, monkeypatch):
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(2000, 8))
    vectors[0] = 1000.0
    monkeypatch.setattr(ann, "centroids", lambda *_: np.array([np.zeros(8), np.full(8, 1000.0)]))
    frame = spark.createDataFrame([(i * 2, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = [r.query_id for r in ann.nearest(frame, F.col("id") % 50 == 0).collect()]
    assert {q: got.count(q) for q in set(got)} == {q: 10 for q in range(0, 4000, 50)}


def test_rolling_hash_is_the_gear_hash():
    data = np.frombuffer(os.urandom(500), np.uint8)
    h, want = 0, []
    for b in data:
        h = ((h << 1) + int(chunks.GEAR[b])) & 0xFFFFFFFF
        want.append(h)
    assert chunks.rolling(data).tolist() == want


def test_borders(monkeypatch):
    text = (LONG + "é中😀" * 900).encode()
    ends = chunks.borders(text)
    assert ends[-1] == len(text) and all(b - a <= chunks.MOST for a, b in zip([0, *ends], ends))
    for a, b in zip([0, *ends], ends):
        text[a:b].decode()
    monkeypatch.setattr(chunks, "SLICE", 1000)
    assert chunks.borders(text) == ends
    moved = chunks.borders(b"inserted words " + text)
    assert len({e - 15 for e in moved} & set(ends)) > 0.95 * len(ends)
    assert chunks.borders(b"") == [] and chunks.borders(b"x") == [1]


def test_repeated_passages(spark):
    rng = random.Random(11)
    passage = prose(rng, 60)
    rows = [(i, prose(rng, 80)) for i in range(50)]
    rows += [(100 + i, f"{prose(rng, rng.randint(5, 60))} {passage} {prose(rng, 30)}") for i in range(30)]
    docs = docs_of(spark, [*rows, *ODD, rows[0]])
    spans = chunks.repeated(docs)
    found = spans.collect()
    flagged = {r.doc_id for r in found if r.doc_id >= 100}
    assert flagged == set(range(101, 130)) and all(100 in r.first_doc_ids for r in found if r.doc_id >= 100)
    assert {r.doc_id for r in found} <= flagged | {6}  # the long text repeats itself
    texts = dict(rows)
    for r in found:
        if r.doc_id >= 100:
            assert texts[r.doc_id][r.start : r.end] in texts[100] and r.end - r.start > 96
    cleaned = chunks.without(docs, spans)
    assert cleaned.columns == docs.columns and cleaned.count() == docs.count()
    left = {r.doc_id: r.text for r in cleaned.collect()}
    assert left[100] == texts[100] and left[0] == texts[0]
    r = next(r for r in found if r.doc_id == 101)
    assert left[101] == texts[101][: r.start] + texts[101][r.end :]
    assert chunks.repeated(docs.limit(0)).count() == 0


# quality


def test_ablations(spark):
    rng = random.Random(12)
    rows = [(1000 + i, prose(rng, 60)) for i in range(20)] + [(100 + i, "too short") for i in range(5)] + [(200, "a b c " * 30), (201, "### " * 20)]
    rows = quality.judged(docs_of(spark, rows + ODD))
    assert rows.count() == 27 + len(ODD)
    kept = rows.where("kept").count()
    table = {r.rule: r for r in quality.ablations(rows).collect()}
    assert set(table) == set(quality.POLICIES[quality.CURRENT])
    for name, r in table.items():
        others = sum(quality.bit(n) for n in table if n != name)
        masks = [x.failures for x in rows.select("failures").collect()]
        assert r.failed == sum(bool(m & quality.bit(name)) for m in masks)
        assert r.failed_alone == sum(m == quality.bit(name) for m in masks)
        assert r.kept_without == sum(not m & others for m in masks) >= kept
    assert rows.where("doc_id = 100").first().base_failed and rows.where("doc_id = 1").first().failures & 1
    assert quality.judged(docs_of(spark, ODD).limit(0)).count() == 0


# chat


def test_chat(spark):
    odd = ["", None, "</s>[INST] ok [/INST]", "<|end|>", "<|user|>x<|end|>", "a\\", "\\|>", "<\\|", "<<SYS>>\n<</SYS>>", "[", "é😀\n", "<s><|", "\\\\n$1"]
    rng, rows = random.Random(13), []
    for conv in range(40):
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, turn, rng.choice(["system", "user", "assistant", "assistant", "a|>b"]), rng.choice(odd) if rng.random() < 0.7 else prose(rng, 5)))
    rows += [(90, None, None, "x"), (90, None, None, "x"), (90, 3, "assistant", "y")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit("own"))
    found = chat.formatted(frame).collect()
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in found}
    plain = [r if r[1] is not None else (r[0], -1, r[2], r[3]) for r in rows]
    assert got == brute.chat(plain)
    assert {r.conv_id: r.formatted_chars for r in found} == brute.formatted_chars(plain, brute.escaped)
    assert chat.formatted(frame.limit(0)).count() == 0


def test_examples_written_out(spark):
    rows = [(1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (1, 2, "user", "q2"), (1, 3, "assistant", "a<|2"), (1, 4, "user", "tail")]
    rows += [(2, 0, "user", "alone"), (3, 0, "assistant", ""), (3, 1, "assistant", None)]
    examples = chat.expanded(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    full = {(r.conv_id, r.example): r for r in examples.collect()}
    head = "<|user|>q1<|end|><|assistant|>a1<|end|>"
    empty = "<|assistant|><|end|>"
    assert {k: r.text for k, r in full.items()} == {
        (1, 0): head, (1, 1): head + "<|user|>q2<|end|><|assistant|>a<\\|2<|end|>", (1, None): "<|user|>tail<|end|>",
        (2, None): "<|user|>alone<|end|>", (3, 0): empty, (3, 1): empty * 2,
    }
    assert {k for k, r in full.items() if r.last} == {(1, 1), (3, 1)}
    losses = {k: r.text[r.loss_start : r.loss_end] for k, r in full.items() if k[1] is not None}
    assert losses == {(1, 0): "a1", (1, 1): "a<\\|2", (3, 0): "", (3, 1): ""}
    sizes = {r.conv_id: r.formatted_chars for r in chat.read_back(examples).collect()}
    assert sizes == {1: len(head) + len(full[1, 1].text), 2: 0, 3: 3 * len(empty)}


def test_a_conversation_with_many_replies(spark):
    rows = [(1, i, "assistant" if i % 3 else "user", f"t{i}|>") for i in range(chat.BLOCK * 5)]
    frame = spark.createDataFrame(rows + [(2, 0, "assistant", "x")], "conv_id long, turn long, role string, text string")
    examples = chat.expanded(frame)
    assert examples.where("conv_id = 1 and example is not null").count() == sum(r[2] == "assistant" for r in rows)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(examples).collect()}
    assert got == brute.chat(rows + [(2, 0, "assistant", "x")])


# registered queries


@pytest.mark.parametrize("name", [n for n, (_, sql) in queries.queries.items() if sql])
def test_queries_with_sql(spark, name):
    from check import compare, connect

    assert compare(spark, connect(SF), SF, name, queries.queries[name])[0].startswith("ok")


def test_queries_on_given_tables(spark):
    read = lambda t: [tuple(r) for r in spark.read.parquet(f"{SF}/{t}.parquet").collect()]
    run = lambda name: queries.queries[name][0](spark, SF).collect()
    docs = [(r[0], r[1]) for r in read("documents")]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in run("op5_tensored_minhash")} == brute.near_duplicates(docs)
    pages = [(r[0], r[2]) for r in read("pages")]
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in run("op2_warc_zstd")} == brute.warc(pages)
    turns = read("conversations") + [(-1, 0, "user", queries.ODD_TEXT), (-1, 1, "assistant", queries.ODD_TEXT)]
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in run("op9_prefix_target")} == brute.chat(turns)
    vectors = [(r[0], r[1]) for r in read("embeddings")]
    want = brute.nearest(vectors, [i for i, _ in vectors if i % 100 == 0])
    near = {}
    for r in sorted(run("op1_adaptive_scan"), key=lambda r: (r.query_id, r["rank"])):
        near.setdefault(r.query_id, []).append(r.vec_id)
    hits = [len({i for i, _ in want[q]} & set(near[q])) for q in want]
    assert all(len(near[q]) == 10 for q in want) and sum(hits) >= 9 * len(hits)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.stored(stage(spark, docs, SF))
        assert (after.columns == columns) == (name != "encode")
        if name == "near_dedup":
            assert {r.doc_id for r in after.collect()} == {i for i, (_, c) in brute.near_duplicates([(r.doc_id, r.text) for r in docs.collect()]).items() if i == c}
        if name == "personal_data":
            assert not any(brute.base_spans(r.text) for r in after.collect()) and after.count() == docs.count()
        if name == "encode":
            assert after.count() == docs.count()
            texts = sorted(hashlib.sha256((r.text or "").encode()).hexdigest() for r in docs.collect())
            assert sorted(r.decoded_sha256 for r in after.collect()) == texts
        docs = after
    assert before > 0 and base64


def test_pipeline_stages_with_any_columns(spark):
    """Names with dots and blanks, and columns that can't be hashed or compared."""
    import corpus_pipeline

    rng = random.Random(6)
    rows = [(i, prose(rng, 30) + (" a@b.cc" if i % 2 else "")) for i in range(12)] + [(3, None), (None, "x y z")]
    docs = docs_of(spark, rows).withColumns(
        {"x.y": F.lit(1), "a b`c": F.lit("q"), "m": F.create_map(F.lit("k"), F.col("doc_id")), "v": F.parse_json(F.lit("[1]"))}
    )
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, SF))
        assert name == "encode" or docs.columns == columns
    assert docs.count() > 0


@pytest.mark.parametrize("empty", [True, False])
def test_pipeline_stages_on_odd_rows(spark, empty):
    import corpus_pipeline

    docs = docs_of(spark, ODD + [(8, "mail a@b.cc"), (9, "some plain words of text")])
    docs = docs.limit(0) if empty else docs
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, SF))
    assert docs.count() == 0 if empty else docs.count() > 0


def test_pipeline_keeps_one_row_of_a_group(spark):
    import corpus_pipeline

    rng = random.Random(5)
    texts = [prose(rng, 40) for _ in range(6)]
    rows = [(10, texts[0])] * 500 + [(11, texts[0]), (None, texts[0])]  # copies, one without an id
    rows += [(20, texts[1]), (20, texts[2]), (21, texts[2])]  # an id with two texts
    rows += [(None, texts[3])] * 3 + [(None, texts[3] + " tail")]  # no id in the group
    rows += [(30, texts[4]), (31, texts[4]), (31, ""), (None, ""), (None, ""), (None, None), (None, None)]
    rows += [(40, ""), (40, texts[5]), (41, "")]
    docs = docs_of(spark, rows).repartition(5)
    got = corpus_pipeline.near_dedup(spark, docs, SF)
    assert got.columns == docs.columns
    got = got.collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == [10, 20, 30, 40, 41]
    assert {r.doc_id: r.text for r in got if r.doc_id in (10, 30, 40)} == {10: texts[0], 30: texts[4], 40: texts[5]}
    bare = [r.text for r in got if r.doc_id is None]
    assert len(bare) == 3 and bare.count("") == bare.count(None) == 1
    assert [t for t in bare if t] in ([texts[3]], [texts[3] + " tail"])
