"""Vector codes by product quantisation, with codebooks learned by member-resident Lloyd rounds.

Vectors are cut into parts; each position has a codebook. Parts live with the entry they belong to: in a
table bucketed by (position, entry, salt), whose buckets are the owners. In a round an owner sums its
resident members, by a grouping that needs no exchange on buckets; the sums give the new entries, and
then each owner assigns its members again. Only parts whose entry changes are shuffled, to their new
owner; all others are written on where they lie. Salts, as many as a tenth of the root of the number of
rows, spread the members of an entry over owners, so an entry that holds most rows is many groups.

Everything is integers, so sums, entries and errors are exact whatever the order. What reaches the
driver are the codebooks, positions * entries * width numbers.

Components become floor(1024 * x). They are held within a limit, 2^26 for 64 dimensions, at which a
squared distance still fits into a long. Rows whose vector is null, holds null or non-finite components or
hasn't the usual number of dimensions are dropped. Parts have equal widths; where the dimensions don't
divide, the first parts are one wider. Codebooks start from the vectors of the smallest ids, each id
once, with its smallest vector; rows without an id come last and start one entry at most. With fewer ids
than entries the codebooks are as much smaller. Repeated rows count as often as they occur. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changetide.llm.scratch import folder, stored
from changetide.llm.vectors import finite, floored, matrix

FACTOR = 1024
#: Parts in a bucket, about, where the table is large.
BUCKET_ROWS = 1_000_000
OWNER = ["position", "entry", "salt"]


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each part's nearest entry; ties to the lower index; exact."""
    width = max(1, parts.shape[1])
    most = max(int(np.abs(parts).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = np.float64 if 4 * width * most * most < 2**53 else np.int64  # sums that doubles hold exactly
    a, b = parts.astype(kind), entries.astype(kind)
    if kind is np.float64:
        far = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    else:
        far = np.stack([((a - entry) ** 2).sum(1) for entry in b], axis=1)
    index = far.argmin(1)
    return index, far[np.arange(len(far)), index].astype(np.int64)


def cuts(d: int, positions: int) -> list[int]:
    """Where the parts begin, and d."""
    return [0, *np.cumsum([d // positions + (i < d % positions) for i in range(positions)]).tolist()]


def _assigning(books: list[np.ndarray]):
    """Arrow batches (row, position, entry, salt, part) → those with the nearest entry as `next`."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            places = batch.column(1).to_numpy()
            found = np.zeros(len(places), np.int32)
            for position in np.unique(places):
                at = np.flatnonzero(places == position)
                found[at] = nearest(matrix(batch.column(4).take(pa.array(at))), books[position])[0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, "next"])

    return run


class Residents:
    """Parts (row, position, entry, salt, part) in a table bucketed by owner; a table for each round."""

    FIELDS = "row long, position int, entry int, salt int, part array<long>"

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets = spark, buckets
        self.database = f"llm_{uuid.uuid4().hex}"
        self.name = None
        spark.sql(f"CREATE DATABASE {self.database} LOCATION '{folder(spark)}'")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def settle(self, parts: DataFrame) -> None:
        """Make these the residents; the table before goes."""
        name = f"{self.database}.members_{uuid.uuid4().hex}"
        parts.write.bucketBy(self.buckets, *OWNER).sortBy(*OWNER, "row").saveAsTable(name)
        if self.name:
            self.spark.sql(f"DROP TABLE {self.name}")
        self.name = name

    def close(self) -> None:
        self.spark.sql(f"DROP DATABASE {self.database} CASCADE")

    def assigned(self, books: list[np.ndarray]) -> DataFrame:
        """The members with their nearest entry now as `next`."""
        return self.table().select("row", *OWNER, "part").mapInArrow(_assigning(books), self.FIELDS + ", next int")

    def after(self, books: list[np.ndarray], moved: DataFrame) -> DataFrame:
        """Who stays, read where it lies, and who has come from elsewhere: the one shuffle of a round."""
        stay = self.assigned(books).where("next = entry").select("row", *OWNER, "part")
        come = moved.select("row", "position", F.col("next").alias("entry"), "salt", "part")
        return stay.unionByName(come.repartition(self.buckets, *OWNER))

    def sums(self) -> DataFrame:
        """(position, entry, place, n, s): n members and the sum of one of their components.

        The grouping by owner runs on the buckets; only its few results are exchanged."""
        own = self.table().select(*OWNER, F.posexplode("part").alias("place", "c"))
        own = own.groupBy(*OWNER, "place").agg(F.count("*").alias("n"), F.sum("c").alias("s"))
        return own.groupBy("position", "entry", "place").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def first_books(rows: DataFrame, entries: int, at: list[int]) -> list[np.ndarray]:
    """The parts of the vectors with the smallest ids."""
    least = rows.groupBy("id").agg(F.min("x").alias("x")).orderBy(F.asc_nulls_last("id")).limit(entries).collect()
    whole = np.array([r["x"] for r in sorted(least, key=lambda r: (r["id"] is None, r["id"] or 0))], np.int64)
    return [whole[:, low:high] for low, high in zip(at, at[1:])]


def fitted(rows: DataFrame, positions: int, entries: int, rounds: int) -> list[np.ndarray]:
    """Codebooks over rows (row, id, x)."""
    spark = rows.sparkSession
    first = rows.select(F.size("x").alias("d")).first()
    at = cuts(first["d"], positions)
    books = first_books(rows, entries, at)
    count = rows.count()
    salts = math.ceil(math.sqrt(count) / 10)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count * positions // BUCKET_ROWS))
    cut = F.array(*(F.slice("x", low + 1, high - low) for low, high in zip(at, at[1:])))
    parts = rows.select("row", F.posexplode(cut).alias("position", "part"))
    salt = F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int")
    parts = parts.select("row", "position", F.lit(-1).alias("entry"), salt.alias("salt"), "part")
    residents = Residents(spark, buckets)
    try:
        for i in range(rounds):
            if i == 0:
                dealt = parts.mapInArrow(_assigning(books), Residents.FIELDS + ", next int")
                dealt = dealt.select("row", "position", F.col("next").alias("entry"), "salt", "part")
                residents.settle(dealt.repartition(buckets, *OWNER))
            else:
                moved = stored(residents.assigned(books).where("next <> entry"))
                if moved.isEmpty():
                    break  # all stay, so the entries do as well
                residents.settle(residents.after(books, moved))
            books = [b.copy() for b in books]
            for r in residents.sums().collect():
                books[r["position"]][r["entry"], r["place"]] = r["s"] // r["n"]
    finally:
        residents.close()
    return books


def books_sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for book in books for v in book.ravel().tolist()).encode()).hexdigest()


def coded(rows: DataFrame, books: list[np.ndarray], more: str) -> DataFrame:
    """(id, more, code, error) of rows (id, more, x): indexes in two hex digits each, squared distances summed."""
    at = cuts(sum(b.shape[1] for b in books), len(books))
    kind = rows.schema[more].dataType.simpleString()

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(2))
            found = [nearest(x[:, low:high], book) for low, high, book in zip(at, at[1:], books)]
            codes = ["".join(f"{i:02x}" for i in row) for row in zip(*(index.tolist() for index, _ in found))]
            errors = pa.array(sum(far for _, far in found))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes), errors], names=["id", more, "code", "error"])

    return rows.select("id", more, "x").mapInArrow(run, f"id long, `{more}` {kind}, code string, error long")


def compressed(
    vectors: DataFrame,
    positions: int = 4,
    entries: int = 256,
    rounds: int = 4,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """One row per kept row: vec_id, code, error, label_error, codebooks_sha256."""
    labelled = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"))
    kept = finite(labelled, "id", "v", "label")
    first = kept.select(F.size("v").alias("d")).first()
    if first is None:
        schema = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
        return vectors.sparkSession.createDataFrame([], schema)
    limit = 2 ** ((62 - math.ceil(math.log2(4 * first["d"]))) // 2)
    x = floored("v", FACTOR, 0, limit).alias("x")
    rows = stored(kept.select(F.monotonically_increasing_id().alias("row"), "id", "label", x))
    books = fitted(rows, positions, entries, rounds)
    codes = stored(coded(rows, books, "label"))
    by_label = stored(codes.groupBy("label").agg(F.sum("error").alias("label_error")))
    named = by_label.withColumnRenamed("label", "of")
    return codes.join(named, F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256")
    )
