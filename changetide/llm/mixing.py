"""Mixing sources to target weights by pivotal dependent rounding.

Every source has a target of words; target / size of its source is the number of copies each of its
documents should have on average. The whole part is taken for certain. The fractions are rounded
together: two documents with open fractions meet, and words move at random from one to the other
until one of them is a whole copy or none. The draw keeps each document's expected copies, and moving
words rather than copies keeps the source's words, so a source misses its target by half a document at
most. Rows are dealt by hash into runs of bounded size; each run of a source leaves one open
fraction at most, and these meet in a tree of the same step, up to one per source.

All draws are hashes of the seed, the level and the rows' own ids, and runs are sorted by hash, so a
rerun and a retried task make the same choice. Null text has size 0 and is taken 0 times. A null
source is a source of its own, last in order. Repeated rows are rounded each for itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from changetide.llm.scratch import columns_of, stored

WORD = r"[^\x20\x09-\x0D]+"
RUN_ROWS = 50_000
FAN_IN = 64
CLOSE = 1e-9


def size_of(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """Rank sources by code point from 0, null last, without one task that sorts them all."""
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = (F.col("source").isNull(), F.col("source"))
    dealt = stored(sources.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    totals = {r["part"]: r["n"] for r in dealt.groupBy("part").agg(F.count("*").alias("n")).collect()}
    before, offsets = 0, []
    for part in sorted(totals):
        offsets += [F.lit(part), F.lit(before)]
        before += totals[part]
    if not offsets:
        return dealt.withColumn("rank", F.lit(0).cast("long")).drop("part")
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return dealt.withColumn("rank", (inside - 1 + F.element_at(F.create_map(*offsets), F.col("part"))).cast("long")).drop("part")


def targets(sizes: DataFrame, weights: tuple[int, ...], percent: int, most: int) -> DataFrame:
    """(source, source_size, target): shares by weight; what exceeds most times a source's size is
    shared again among the others, until nothing does."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = stored(_ranked(sources).withColumn("weight", weight.cast("double")))
    whole = sources.agg(F.sum("source_size")).first()[0] or 0
    left, level = whole * percent / 100, None
    while True:  # the level only rises, and each round fills a source at least
        over = F.col("weight") * F.lit(level) > most * F.col("source_size") if level is not None else F.lit(False)
        full, open_weight = sources.agg(
            F.sum(F.when(over, most * F.col("source_size")).otherwise(0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))
        ).first()
        if not open_weight:
            break
        risen = (left - (full or 0)) / open_weight
        if level is not None and risen <= level:
            break
        level = risen
    share = F.least(F.col("weight") * F.lit(level or 0.0), (most * F.col("source_size")).cast("double"))
    return sources.select("source", "source_size", share.alias("target"))


def _draw(seed: int, level: int, a: tuple, b: tuple) -> float:
    return xxh3_64_intdigest(repr((seed, level, a[:3], b[:3])).encode()) / 2.0**64


def settle(rows: list[tuple], seed: int, level: int) -> list[tuple]:
    """Round one run: (doc_id, mark, size, open fraction) in a fixed order → the same rows with the
    fraction 0 or 1 for all but one."""
    done, held = [], None
    for row in rows:
        if row[3] <= CLOSE or row[3] >= 1 - CLOSE or row[2] == 0:
            done.append((*row[:3], float(round(row[3])) if row[2] else 0.0))
        elif held is None:
            held = row
        else:
            a, b = held, row
            # words that may move from b to a, and from a to b
            up = min((1 - a[3]) * a[2], b[3] * b[2])
            down = min(a[3] * a[2], (1 - b[3]) * b[2])
            moved = up if _draw(seed, level, a, b) * (up + down) < down else -down
            pair = [(*r[:3], r[3] + m / r[2]) for r, m in ((a, moved), (b, -moved))]
            held = None
            for r in pair:
                if CLOSE < r[3] < 1 - CLOSE:
                    held = r
                else:
                    done.append((*r[:3], float(round(r[3]))))
    return done + ([held] if held else [])


def _settled(rows: DataFrame, seed: int, level: int) -> DataFrame:
    """Rows sorted by run within partitions → rounded; is_open marks what a run leaves open."""

    def run(batches):
        current, held = None, []

        def out(found):
            done = settle(found, seed, level)
            n = len(done)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([current[0]] * n, pa.string()),
                    pa.array([current[1]] * n, pa.int64()),
                    pa.array([d[0] for d in done], pa.int64()),
                    pa.array([d[1] for d in done], pa.int64()),
                    pa.array([d[2] for d in done], pa.int64()),
                    pa.array([d[3] for d in done], pa.float64()),
                    pa.array([0 < d[3] < 1 for d in done], pa.bool_()),
                ],
                names=["source", "run", "doc_id", "mark", "size", "part", "is_open"],
            )

        for batch in batches:
            for source, key, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (source, key) != current:
                    if held:
                        yield out(held)
                    current, held = (source, key), []
                held.append(tuple(row))
                if len(held) >= RUN_ROWS:  # a run of any length needs no more memory than this
                    done = settle(held, seed, level)
                    held = [done.pop()] if 0 < done[-1][3] < 1 else []
                    if done:
                        yield out(done)
        if held:
            yield out(held)

    schema = "source string, run long, doc_id long, mark long, size long, part double, is_open boolean"
    return rows.select("source", "run", "doc_id", "mark", "size", "part").mapInArrow(run, schema)


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    order = F.xxhash64("mark", "doc_id")
    return rows.repartition(parts, "run", "source").sortWithinPartitions("run", "source", order, "doc_id", "mark", "size")


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    percent: int = 150,
    most: int = 2,
    seed: int = 6,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies and mark of every row; mark: a hash of the text."""
    sizes = stored(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            size_of(text_col).alias("size"),
            F.xxhash64(F.col(text_col).cast("string")).alias("mark"),
        )
    )
    goals = stored(targets(sizes, weights, percent, most))
    goal = goals.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    # a source may hold any share of the rows: its goal joins the rows by source, and skewed joins are split
    rate = sizes.join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    total = sizes.count()
    runs = max(1, -(-total // RUN_ROWS))
    whole = F.floor(F.col("rate") + CLOSE)
    open_rows = rate.select(
        "source", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(runs)).alias("run"), "doc_id", "mark", "size",
        F.greatest(F.col("rate") - whole, F.lit(0.0)).alias("part"),
    )
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    level, done = 0, []
    while True:
        settled = stored(_settled(_dealt(open_rows, parts), seed, level))
        if runs == 1:
            # what is open at the root, one document of a source at most, goes to the nearer side
            done.append(settled.withColumn("part", F.round("part")))
            break
        done.append(settled.where(~F.col("is_open")))
        level, runs = level + 1, -(-runs // FAN_IN)
        open_rows = settled.where("is_open").withColumn("run", F.floor(F.col("run") / FAN_IN))
    decided = done[0]
    for more in done[1:]:
        decided = decided.unionAll(more)
    named = decided.join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    copies = F.when(F.col("size") == 0, 0).otherwise(whole + F.round("part")).cast("long").alias("copies")
    named = named.select("doc_id", "mark", "source", "size", "source_size", "target", copies)
    return named.withColumn("taken", F.col("copies") * F.col("size"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents of the mix: every row of docs as often as it is taken, columns as they are.

    Rows alike in id and text are taken equally often: the rounded mean of their copies."""
    plan = mix(docs, id_col=id_col, text_col=text_col, **options)
    plan = plan.groupBy("doc_id", "mark").agg(F.round(F.avg("copies")).cast("int").alias("__copies")).where("__copies > 0")
    plan = plan.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), "__copies")
    keyed = docs.withColumn("__text", F.xxhash64(F.col(text_col).cast("string")))
    both = F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__mark"))
    joined = keyed.join(plan, both)
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(columns_of(docs))
