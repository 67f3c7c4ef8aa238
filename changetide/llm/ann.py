"""Nearest neighbours by adaptive dimension scan over inverted lists.

Vectors are rotated at random, so that any number of leading dimensions gives an unbiased estimate of
a distance, and dealt to the lists of their nearest centroids. A list is stored in chunks of bounded
size, rotated coordinates dimension by dimension. A query scans the chunks of its nearest lists in
blocks of dimensions: after each block, candidates whose partial distance, scaled up, exceeds the
distance of the k-th found so far by more than chance allows are given up. Survivors are measured
exactly on the original vectors. The first list is scanned alone; its k-th distance is the bound with
which all other lists are scanned.

Centroids are fitted on a bounded sample (sample_rows, sample_bytes), started from distinct vectors,
and those that end without a row are dropped; every row is in the index. The number of lists that
queries probe is the smallest that holds target_recall of the true neighbours of calibration
queries, which are compared with every row. Queries that find fewer than k rows there, though there
are more, probe twice as many lists, and so on until they have k or have seen all lists. Chunks of one list are dealt over tasks by a
hash of their ids, so a list that holds most rows is scanned by many tasks.

Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do
those whose number of dimensions isn't the most frequent one (ties: the smaller), nor null ids. Repeated rows of
one id count once. Ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changetide.llm.scratch import drawn, stored

CHUNK = 4096
QUERIES = 256


def usable(frame: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows that take part."""
    v = F.col("v")
    rows = frame.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return rows.where(F.size("v") == (sizes["d"] if sizes else 0))


def _matrix(column: pa.ListArray, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def centroids(sample: np.ndarray, lists: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    distinct = np.sort(np.unique(sample, axis=0, return_index=True)[1])
    lists = min(lists, len(distinct))
    means = sample[distinct[rng.choice(len(distinct), lists, replace=False)]].copy()
    for _ in range(rounds):
        near = _squared(sample, means).argmin(1)
        sums = np.zeros_like(means)
        np.add.at(sums, near, sample)
        n = np.bincount(near, minlength=lists)
        means = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], means)
    return means[np.unique(_squared(sample, means).argmin(1))]


def rotation(d: int, seed: int = 2) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def scan(ids, rotated, original, q_ids, q_rotated, q_original, bounds, k: int, block: int, epsilon: float):
    """(query, id, distance) of the up to k nearest of a chunk to each query, none beyond its bound.

    rotated: one row for each dimension; bounds: distances, may be infinite."""
    d = len(rotated)
    out_q, out_id, out_s = [], [], []
    for i, query in enumerate(q_ids):
        alive = np.flatnonzero(ids != query)
        partial = np.zeros(len(alive), np.float32)
        bound = bounds[i]
        for at in range(0, d, block):
            if not len(alive):
                break
            rows = rotated[at : at + block]
            part = rows if len(alive) == rows.shape[1] else rows[:, alive]
            gap = part - q_rotated[i, at : at + block, None]
            partial = partial + np.einsum("ij,ij->j", gap, gap)
            seen = min(at + block, d)
            if seen < d and np.isfinite(bound):
                keep = partial * (d / seen) <= (bound * (1 + epsilon / np.sqrt(seen))) ** 2
                alive, partial = alive[keep], partial[keep]
        if not len(alive):
            continue
        if len(alive) > 4 * k:  # rotated distances are near enough to leave out the far ones
            limit = np.partition(partial, k - 1)[k - 1]
            alive = alive[partial <= limit * 1.001 + 1e-6]
        gap = original[alive].astype(np.float64) - q_original[i].astype(np.float64)
        score = np.sqrt(np.einsum("ij,ij->i", gap, gap))
        order = np.lexsort((ids[alive], score))[:k]
        order = order[score[order] <= bound]
        out_q.append(np.full(len(order), query))
        out_id.append(ids[alive][order])
        out_s.append(score[order])
    if not out_q:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return np.concatenate(out_q), np.concatenate(out_id), np.concatenate(out_s)


class Index:
    """vectors (id, v) dealt to lists; chunks as a stored table (list, salt, ids, rotated, original)."""

    def __init__(self, vectors: DataFrame, max_lists: int, sample_rows: int, sample_bytes: int):
        element = vectors.schema["v"].dataType.elementType
        self.kind = np.float32 if isinstance(element, T.FloatType) else np.float64
        self.spark = vectors.sparkSession
        first = vectors.select(F.size("v").alias("d")).first()
        self.d = first["d"] if first else 0
        self.rows = vectors.count() if first else 0
        if not self.rows:
            return
        bound = max(1, min(sample_rows, sample_bytes // (8 * self.d)))
        sample = drawn(vectors, bound, "id").select("v").toArrow().column(0).combine_chunks()
        lists = min(max_lists, int(np.ceil(np.sqrt(self.rows))))
        self.means = centroids(_matrix(sample, np.float64), lists)
        self.lists = len(self.means)
        self.assigned = stored(self._assigned(vectors))
        counts = {r["list"]: r["n"] for r in self.assigned.groupBy("list").agg(F.count("*").alias("n")).collect()}
        self.salts = {k: -(-n // CHUNK) for k, n in counts.items()}
        self.chunks = stored(self._chunks())

    def _assigned(self, vectors: DataFrame) -> DataFrame:
        means, kind = self.spark.sparkContext.broadcast(self.means), self.kind

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    x = _matrix(batch.column(1), np.float64)
                    near = np.concatenate([_squared(x[i : i + 1024], means.value).argmin(1) for i in range(0, len(x), 1024)])
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], names=["id", "v", "list"])

        return vectors.mapInArrow(run, T.StructType([*vectors.schema.fields, T.StructField("list", T.IntegerType())]))

    def salt(self, list_col: str, id_col: str) -> Column:
        salts = F.create_map(*(F.lit(int(x)) for kv in self.salts.items() for x in kv))
        return F.pmod(F.xxhash64(id_col), F.element_at(salts, F.col(list_col))).cast("int")

    def _packed(self, rows: DataFrame, extra: str | None, most: int, turned: bool) -> DataFrame:
        """Rows of one (list, salt), up to most at once, in one row: ids, rotated, original, extra."""
        turn, kind = self.spark.sparkContext.broadcast(rotation(self.d)), self.kind

        def run(batches):
            key, ids, parts, extras = None, [], [], []

            def out():
                x, n = np.concatenate(parts), np.concatenate(ids)
                more = np.concatenate(extras)
                at = np.unique(n, return_index=True)[1]  # sorted by id; repeated rows once
                x, n, more = x[at], n[at], more[at]
                rotated = (x.astype(np.float64) @ turn.value).astype(np.float32)
                rotated = np.ascontiguousarray(rotated.T if turned else rotated)
                values = [key[0]], [key[1]], [n.tobytes()], [rotated.tobytes()], [x.astype(kind).tobytes()], [more.tobytes()]
                kinds = pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()
                names = ["list", "salt", "ids", "rotated", "original", "extra"]
                return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=names)

            for batch in batches:
                if not batch.num_rows:
                    continue
                lists, salts, n = (batch.column(i).to_numpy() for i in range(3))
                x, more = _matrix(batch.column(3), kind), batch.column(4).to_numpy()
                edges = np.flatnonzero((np.diff(lists) != 0) | (np.diff(salts) != 0)) + 1
                for a, b in zip([0, *edges], [*edges, len(n)]):
                    if key != (lists[a], salts[a]) and key is not None and ids:
                        yield out()
                        ids, parts, extras = [], [], []
                    key = (lists[a], salts[a])
                    while a < b:
                        take = min(b, a + most - sum(map(len, ids)))
                        ids.append(n[a:take]), parts.append(x[a:take]), extras.append(more[a:take])
                        a = take
                        if sum(map(len, ids)) >= most:
                            yield out()
                            ids, parts, extras = [], [], []
            if ids:
                yield out()

        count = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.select("list", "salt", "id", "v", (F.col(extra) if extra else F.lit(0.0)).alias("extra"))
        rows = rows.repartition(count, "list", "salt").sortWithinPartitions("list", "salt", "id")
        return rows.mapInArrow(run, "list int, salt int, ids binary, rotated binary, original binary, extra binary")

    def _chunks(self) -> DataFrame:
        rows = self.assigned.withColumn("salt", self.salt("list", "id"))
        return self._packed(rows, None, 2 * CHUNK, True).drop("extra")

    def probes(self, queries: DataFrame, count: int, start: int = 0) -> DataFrame:
        """(id, v, list, turn) for the count lists nearest to each query, from place start on; turn from 0."""
        means = self.spark.sparkContext.broadcast(self.means)

        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _matrix(batch.column(1), np.float64)
                near = np.concatenate(
                    [np.argsort(_squared(x[i : i + 256], means.value), 1, kind="stable")[:, start : start + count] for i in range(0, len(x), 256)]
                )
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(list(near.astype(np.int32)), pa.list_(pa.int32()))], names=["id", "v", "near"]
                )

        schema = T.StructType([*queries.schema.fields, T.StructField("near", T.ArrayType(T.IntegerType()))])
        return queries.mapInArrow(run, schema).select("id", "v", F.posexplode("near").alias("turn", "list"))

    def scanned(self, probes: DataFrame, k: int, block: int, epsilon: float) -> DataFrame:
        """(query_id, vec_id, score): for each probe (id, v, list, bound) the candidates within its bound."""
        kind, d = self.kind, self.d
        salts = F.create_map(*(F.lit(int(x)) for kv in self.salts.items() for x in kv))
        blocks = probes.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)).cast("int"))
        blocks = self._packed(blocks, "bound", QUERIES, False)
        blocks = blocks.select("list", *(F.col(c).alias(f"q_{c}") for c in ("ids", "rotated", "original", "extra")))
        blocks = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.element_at(salts, F.col("list")) - 1)))
        pairs = self.chunks.join(blocks, ["list", "salt"]).drop("list", "salt")

        def run(batches):
            for batch in batches:
                for row in zip(*(batch.column(i) for i in range(batch.num_columns))):
                    ids, rotated, original, q_ids, q_rotated, q_original, bounds = (c.as_buffer() for c in row)
                    ids, q_ids = np.frombuffer(ids, np.int64), np.frombuffer(q_ids, np.int64)
                    found = scan(
                        ids, np.frombuffer(rotated, np.float32).reshape(d, len(ids)),
                        np.frombuffer(original, kind).reshape(len(ids), d), q_ids,
                        np.frombuffer(q_rotated, np.float32).reshape(len(q_ids), d),
                        np.frombuffer(q_original, kind).reshape(len(q_ids), d),
                        np.frombuffer(bounds, np.float64), k, block, epsilon,
                    )
                    yield pa.RecordBatch.from_arrays([pa.array(f) for f in found], names=["query_id", "vec_id", "score"])

        return pairs.mapInArrow(run, "query_id long, vec_id long, score double")

    def probe_count(self, queries: DataFrame, k: int, calibration: int, target_recall: float) -> int:
        """How many lists hold target_recall of the true neighbours of some queries."""
        if self.lists == 1:
            return 1
        sample = drawn(queries, calibration, "id").toArrow().combine_chunks()
        if not sample.num_rows:
            return 1
        q_ids = sample.column(0).to_numpy()
        q = _matrix(sample.column(1).combine_chunks(), np.float64)
        shared = self.spark.sparkContext.broadcast((q_ids, q))

        def run(batches):
            ids, x = shared.value
            best = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                n, lists = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                far = _squared(x, _matrix(batch.column(1), np.float64))
                far[ids[:, None] == n[None, :]] = np.inf
                at = np.argpartition(far, min(k, far.shape[1] - 1), 1)[:, :k]
                rows = (np.take_along_axis(far, at, 1), n[at], lists[at])
                if best is not None:
                    rows = tuple(np.concatenate(p, 1) for p in zip(best, rows))
                    at = np.argsort(rows[0], 1)[:, :k]
                    rows = tuple(np.take_along_axis(r, at, 1) for r in rows)
                best = rows
            if best is not None:
                far, n, lists = (b.ravel() for b in best)
                which = np.repeat(np.arange(len(ids)), best[0].shape[1])
                keep = np.isfinite(far)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[keep]) for c in (which, far, n, lists.astype(np.int32))], names=["q", "far", "id", "list"]
                )

        near = self.assigned.mapInArrow(run, "q long, far double, id long, list int")
        place = F.row_number().over(Window.partitionBy("q").orderBy("far", "id"))
        truth = near.withColumn("place", place).where(F.col("place") <= k).collect()
        order = np.argsort(np.argsort(_squared(q, self.means), 1, kind="stable"), 1)
        turns = np.sort([order[r["q"], r["list"]] for r in truth])
        if not len(turns):
            return self.lists
        return int(turns[min(len(turns) - 1, int(np.ceil(target_recall * len(turns))) - 1)]) + 1


def nearest(
    vectors: DataFrame,
    queries: Column,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    max_lists: int = 1024,
    sample_rows: int = 20_000,
    sample_bytes: int = 32 << 20,
    calibration: int = 64,
    target_recall: float = 0.97,
    block: int = 16,
    epsilon: float = 2.1,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found to each row that `queries` selects.

    queries is a condition on the column id."""
    rows = usable(vectors, id_col, vector_col)
    index = Index(rows, max_lists, sample_rows, sample_bytes)
    if not index.rows:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = stored(rows.where(queries).dropDuplicates(["id"]))
    count = index.probe_count(asked, k, calibration, target_recall)
    probes = stored(index.probes(asked, count))
    first = probes.where("turn = 0").withColumn("bound", F.lit(float("inf")))
    found = stored(index.scanned(first, k, block, epsilon))
    place = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    bounds = ranked.withColumn("place", F.row_number().over(place)).where(F.col("place") == k)
    bounds = bounds.select(F.col("query_id").alias("id"), F.col("score").alias("bound"))
    rest = probes.where("turn > 0").join(bounds, "id", "left").fillna(float("inf"), ["bound"])
    every = found.unionAll(stored(index.scanned(rest, k, block, epsilon)))
    every = stored(every.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")))
    enough = min(k, rows.select("id").distinct().count() - 1)
    while count < index.lists:  # each time twice the lists, so a few rounds at most
        full = every.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= enough)
        asked = stored(asked.join(full.select(F.col("query_id").alias("id")), "id", "left_anti").select("id", "v"))
        if not enough or asked.isEmpty():
            break
        more = index.probes(asked, count, count).withColumn("bound", F.lit(float("inf")))
        every = stored(every.unionAll(index.scanned(more, k, block, epsilon)))
        count *= 2
    ranked = every.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
