"""Whitening, SimHash and vector codes against plain versions, with the odd cases."""

import hashlib
import os
import random
import re
import sys
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

sys.path.insert(0, os.path.dirname(__file__))

from changetide.llm import bidiagonal, lloyd, simhash, whitening  # noqa: E402

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")
VECTORS = "vec_id long, embedding array<float>, label int"


def with_clashes(frame):
    """Columns whose names the operators use themselves, and names that need quoting."""
    names = ("id", "v", "x", "row", "part", "entry", "position", "salt", "n", "bits", "a.b", "error", "x.y")
    return frame.withColumns({c: F.lit("own") for c in names}).withColumn("map", F.create_map(F.lit("k"), F.lit(1)))


def odd_vectors(rng, n=300, d=8):
    rows = [(i, [float(x) for x in np.float32(rng.standard_normal(d))], int(i % 3)) for i in range(n)]
    rows += [(rows[5][0], rows[5][1], 1)] * 3 + [(1000 + i, rows[7][1], None) for i in range(200)]  # repeated rows, copies
    rows += [(None, rows[9][1], None), (None, [0.0] * d, 2), (None, None, 1)]
    rows += [(2000, None, 0), (2001, [NAN] + [0.0] * (d - 1), 0), (2002, [INF] * d, 0), (2003, [None] * d, 0)]
    rows += [(2004, [], 0), (2005, [1.0] * (d + 1), 0), (2006, [0.0] * d, None)]
    return rows


def usable(rows, d=8):
    return [r for r in rows if r[1] is not None and len(r[1]) == d and all(x is not None and np.isfinite(x) for x in r[1])]


# singular values


def sample_matrices():
    rng = np.random.default_rng(1)
    turn = lambda n: np.linalg.qr(rng.standard_normal((n, n)))[0]
    yield rng.standard_normal((1, 1))
    yield np.linalg.qr(rng.standard_normal((200, 40)), mode="r")
    yield np.eye(20) * 3
    yield turn(48) @ np.diag(np.r_[np.ones(15), np.full(15, 1 + 1e-12), np.full(18, 0.5)]) @ turn(48)
    yield np.triu(rng.standard_normal((30, 30))) * np.logspace(0, -12, 30)[:, None]
    yield np.linalg.qr(rng.standard_normal((100, 4)) @ rng.standard_normal((4, 32)), mode="r")
    near = np.diag(np.abs(np.arange(-10.0, 11))) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1) + 12 * np.eye(21)
    yield np.linalg.cholesky(near).T  # pairs of values that agree in nearly all digits


@pytest.mark.parametrize("i", range(7))
def test_singular_values_and_vectors(i):
    square = list(sample_matrices())[i]
    squares, directions = bidiagonal.decomposed(square, 16)
    want = np.linalg.svd(square, compute_uv=False) ** 2
    assert np.abs(squares - want).max() <= 1e-13 * want[0]
    k = directions.shape[1]
    assert k == min(16, (want > 1e-26 * want[0]).sum())
    assert np.abs(directions.T @ directions - np.eye(k)).max() < 1e-11
    assert np.abs(square.T @ (square @ directions) - directions * squares[:k]).max() < 1e-13 * want[0]


def test_small_values_keep_their_digits():
    diagonal, above = np.logspace(0, -9, 12), np.logspace(-1, -10, 11)
    got = np.array(bidiagonal.dqds((diagonal**2).tolist(), (above**2).tolist()))
    inverse = np.linalg.svd(np.linalg.inv(np.diag(diagonal) + np.diag(above, 1)), compute_uv=False)
    assert abs(got[-1] * inverse[0] ** 2 - 1) < 1e-12


# whitening


def plain_whitening(rows, components=16):
    """{id: …} is not enough with repeated ids, so a list of (id, deviation, whitened up to signs) and the shares."""
    x = np.floor(64 * np.array([r[1] for r in rows], np.float64)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    y = (n * fit - sums) / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    white = ((n * x - sums) / n) @ axes / np.sqrt(values)
    return n, ((n * x - sums) ** 2).sum(axis=1), white, values / np.trace(y.T @ y / n)


def test_whitening(spark):
    rows = odd_vectors(np.random.default_rng(2))
    frame = with_clashes(spark.createDataFrame(rows, VECTORS)).repartition(7)
    got = whitening.whitened(frame, 5).collect()
    kept = usable(rows)
    n, deviations, white, shares = plain_whitening(kept, 5)
    assert len(got) == 5 * len(kept) and {r.n for r in got} == {n}
    held = defaultdict(list)
    for r in got:
        held[r.vec_id, r.component].append(r)
        assert abs(r.explained - shares[r.component - 1]) < 1e-12 and r.identity_error < 1e-10
    ids = [r[0] for r in kept]
    for k in range(5):
        one = ids.index(3)
        sign = np.sign(held[3, k + 1][0].whitened * white[one, k])
        want = defaultdict(list)
        for i, deviation, value in zip(ids, deviations, white[:, k] * sign):
            want[i].append((int(deviation), value))
        for i, pairs in want.items():
            found = sorted((r.deviation, r.whitened) for r in held[i, k + 1])
            assert [f[0] for f in found] == [p[0] for p in sorted(pairs)]
            assert np.allclose([f[1] for f in found], [p[1] for p in sorted(pairs)], atol=1e-9)


def test_whitening_of_many_blocks(spark, monkeypatch):
    """More triangles than are stacked at once."""
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(np.random.default_rng(3).standard_normal((400, 6)))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(9)
    got = {(r.vec_id, r.component): r.whitened for r in whitening.whitened(frame, 6).collect()}
    white = plain_whitening(rows, 6)[2]
    for k in range(6):
        own = np.array([got[i, k + 1] for i in range(400)])
        assert min(np.abs(own - white[:, k]).max(), np.abs(own + white[:, k]).max()) < 1e-9


def test_whitening_without_variance(spark):
    one = whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], VECTORS)).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one) == [
        (i, k, 1, 0, None, 0.0, 0.0) for i in (1, 2) for k in (1, 2)
    ]
    flat = [(i, [float(i), 3.0, 0.0], 0) for i in range(50)]  # one dimension varies
    got = whitening.whitened(spark.createDataFrame(flat, VECTORS)).collect()
    assert {(r.component, r.whitened is None) for r in got} == {(1, False), (2, True), (3, True)}
    assert all(abs(r.explained - (r.component == 1)) < 1e-12 and r.identity_error < 1e-10 for r in got)
    far = whitening.whitened(spark.createDataFrame([(1, [3e38, 0.0], 0), (2, [-3e38, 1.0], 0)], VECTORS)).collect()
    assert {r.deviation for r in far} == {None}
    few = whitening.whitened(spark.createDataFrame([(i, [float(i * j % 5) for j in range(20)], 0) for i in range(4)], VECTORS))
    assert few.where("whitened is not null").select("component").distinct().count() <= 3
    for rows in ([], [(1, None, 0), (2, [NAN], 0)]):
        empty = whitening.whitened(spark.createDataFrame(rows, VECTORS))
        assert empty.count() == 0 and len(empty.columns) == 7


def test_deviations_beyond_longs():
    centre = whitening.Centre(3, [3 * 10**8, 1])
    rows = [[10**8, 0], [0, 0], [10**8 + 7, 5], [2 * 10**9, 7]]
    want = [sum((3 * v - s) ** 2 for v, s in zip(row, (3 * 10**8, 1))) for row in rows]
    assert centre.deviations(np.array(rows)) == [w if w < 2**63 else None for w in want] and want[3] >= 2**63


# SimHash


def plain_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_simhash(rows, radius=2):
    """{doc_id: component} and a list of (doc_id, fingerprint); rows of one id are one document."""
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    nodes = sorted({b for _, b in prints})
    parent = {b: b for b in nodes}

    def root(b):
        while parent[b] != b:
            b = parent[b]
        return b

    for at, a in enumerate(nodes):
        for b in nodes[at + 1 :]:
            if (a ^ b).bit_count() <= radius:
                parent[root(b)] = root(a)
    first = {}
    for i, b in prints:
        if i is not None:
            parent[root(b)] = root(first.setdefault(i, b))
    least = {}
    for i, b in prints:
        if i is not None:
            least[root(b)] = min(least.get(root(b), i), i)
    return sorted((str(i), f"{b:016x}", least.get(root(b))) for i, b in prints)


def simhash_rows(seed=4):
    rng, rows = random.Random(seed), []
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    for i in range(40):
        words = [word() for _ in range(rng.randint(60, 200))]
        rows.append((10 * i, " ".join(words)))
        for j in range(rng.randint(0, 5)):  # a word changed, which moves few bits
            words[rng.randrange(len(words))] = word()
            rows.append((10 * i + 1 + j, " \n".join(words).upper()))
    rows += [(5000 + i, rows[0][1]) for i in range(300)]  # one group of many copies
    rows += [(1, None), (2, ""), (3, " \t\n"), (6000, "one"), (6001, "One TWO"), (6002, "é\u0000ß 中文 x y"), (6003, "x " * 70_000)]
    rows += [(6010, "some text of its own here"), (6010, rows[50][1]), (6010, None), (None, rows[60][1]), (None, "no id and alone"), (7000, "one")]
    return rows


def test_simhash(spark):
    rows = simhash_rows()
    frame = with_clashes(spark.createDataFrame(rows, "doc_id long, text string")).repartition(5)
    for radius in (0, 2):
        got = simhash.near_duplicates(frame, radius=radius).collect()
        assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == sorted(plain_simhash(rows, radius))
    assert simhash.near_duplicates(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        simhash.near_duplicates(frame, radius=3)


@pytest.mark.parametrize("half", [1, 2])
def test_balls_connect_all_within_the_radius(spark, half):
    """Planted fingerprints: chains, dense balls and distances just beyond the radius."""
    rng = random.Random(half)
    found = set()
    for _ in range(25):
        base = rng.getrandbits(64)
        found.add(base)
        for _ in range(8):
            value = rng.choice(sorted(found)[-6:])
            for bit in rng.sample(range(64), rng.randint(1, 2 * half + 1)):
                value ^= 1 << bit
            found.add(value)
    signed = np.array(sorted(found), np.uint64).view(np.int64).tolist()
    pairs = simhash.linked(spark.createDataFrame([(s,) for s in signed], "bits long"), half).collect()
    near = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 2 * half
    assert all(near(r.a, r.b) and r.a < r.b for r in pairs)

    def classes(edges):
        parent = {s: s for s in signed}

        def root(s):
            while parent[s] != s:
                s = parent[s]
            return s

        for a, b in edges:
            parent[max(root(a), root(b))] = min(root(a), root(b))
        return {s: root(s) for s in signed}

    assert classes([(r.a, r.b) for r in pairs]) == classes([(a, b) for a in signed for b in signed if a < b and near(a, b)])


# vector codes


def plain_codes(rows, positions, entries, rounds):
    """[(id, code, error, label)] and the codebooks, for kept rows (id, x, label)."""
    x = np.floor(1024 * np.array([r[1] for r in rows], np.float64)).astype(np.int64)
    at = lloyd.cuts(x.shape[1], positions)
    least = {}
    for (i, _, _), v in zip(rows, x.tolist()):
        least[i] = min(least.get(i, v), v)
    start = [least[i] for i in sorted(least, key=lambda i: (i is None, i or 0))][:entries]

    def near(parts, book):
        far = ((parts[:, None, :] - book[None]) ** 2).sum(axis=2)
        return far.argmin(axis=1), far.min(axis=1)

    books, codes, error = [], [], 0
    for low, high in zip(at, at[1:]):
        book, parts = np.array(start)[:, low:high], x[:, low:high]
        for _ in range(rounds):
            index = near(parts, book)[0]
            book = np.array([parts[index == j].sum(axis=0) // (index == j).sum() if (index == j).any() else book[j] for j in range(len(book))])
        index, far = near(parts, book)
        books.append(book)
        codes.append(index)
        error = error + far
    return [("".join(f"{c:02x}" for c in row), int(e)) for row, e in zip(zip(*codes), error)], books


@pytest.mark.parametrize("positions,entries,rounds,d", [(4, 16, 4, 8), (3, 200, 2, 8), (2, 5, 0, 9), (4, 1000, 3, 8)])
def test_codes(spark, positions, entries, rounds, d):
    rows = odd_vectors(np.random.default_rng(6), 150, d)
    frame = with_clashes(spark.createDataFrame(rows, VECTORS)).repartition(6)
    got = lloyd.compressed(frame, positions, entries, rounds).collect()
    kept = usable(rows, d)
    codes, books = plain_codes(kept, positions, entries, rounds)
    labels = defaultdict(int)
    for r, (_, error) in zip(kept, codes):
        labels[r[2]] += error
    want = sorted((str(r[0]), code, error, labels[r[2]]) for r, (code, error) in zip(kept, codes))
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error) for r in got) == want
    joined = ",".join(str(v) for b in books for v in b.ravel().tolist())
    assert {r.codebooks_sha256 for r in got} == {hashlib.sha256(joined.encode()).hexdigest()}


def test_codes_without_vectors_or_beyond_doubles(spark):
    empty = lloyd.compressed(spark.createDataFrame([(1, None, 0), (2, [NAN], 0)], VECTORS))
    assert empty.count() == 0 and len(empty.columns) == 5
    rows = [(i, [float(3e4 + i), -6e4, 0.5, 3e38], 0) for i in range(30)]
    got = lloyd.compressed(spark.createDataFrame(rows, VECTORS), entries=2).collect()
    assert len(got) == 30 and all(r.error >= 0 for r in got)


def test_nearest_is_exact():
    rng = np.random.default_rng(7)
    for top in (10, 2**20, 2**26):
        parts, book = rng.integers(-top, top, (50, 6)), rng.integers(-top, top, (9, 6))
        book[4] = book[2]
        far = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, e)) for e in book] for p in parts]
        index, error = lloyd.nearest(parts, book)
        assert index.tolist() == [f.index(min(f)) for f in far] and error.tolist() == [min(f) for f in far]


def test_rounds_exchange_only_movers(spark):
    """A round's plans read residents without an exchange; the grouping by owner runs on the buckets."""
    rng = np.random.default_rng(8)
    rows = [(i, 0, i % 5, i % 2, [int(x) for x in rng.integers(0, 100, 2)]) for i in range(500)]
    residents = lloyd.Residents(spark, 8)
    try:
        residents.settle(spark.createDataFrame(rows, lloyd.Residents.FIELDS))
        books = [rng.integers(0, 100, (5, 2))]
        moved = residents.assigned(books).where("next <> entry")
        plan = residents.after(books, spark.createDataFrame(moved.collect(), moved.schema))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Union") < plan.index("Exchange")
        plan = residents.sums()._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
    finally:
        residents.close()
