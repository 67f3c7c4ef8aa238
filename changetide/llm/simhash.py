"""SimHash near duplicates by meeting in the middle of two Hamming balls.

Fingerprints that differ in at most 2 * half bits have a value in common that is at most half bits away
from each of them. So every distinct fingerprint emits all variants within half the radius, and
fingerprints that meet at a variant are candidates. All that meet at one variant lie within the radius
of each other, so each of them is paired with the smallest one alone: nothing connected is lost, and
no bucket puts out all its pairs. A bucket holds one fingerprint for each flip at most, however many
documents share a fingerprint, since only distinct ones are dealt out. The pairs are made distinct and
their distance is verified.

A null text has no words, like an empty one: fingerprint zero, which links like any other. Rows of
one id with different texts connect what their fingerprints are connected with. A row without an id has
a fingerprint that links as well; it gets the component of that, null if no row there has an id.
Repeated rows give repeated rows.
"""

from __future__ import annotations

from itertools import combinations, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from changetide.llm.components import components
from changetide.llm.scratch import stored

SEED = 42
CHUNK = 1 << 15


def fingerprint(data: bytes, width: int = 3) -> int:
    """64 bits, unsigned; a bit is 1 if more than half of the shingles' hashes have it."""
    words = data.lower().split()
    if not words:
        return 0
    size = min(width, len(words))
    total = len(words) - size + 1
    hashes = map(xxh64_intdigest, map(b" ".join, zip(*(islice(words, i, None) for i in range(size)))), repeat(SEED))
    ones = np.zeros(64, np.int64)
    for at in range(0, total, CHUNK):  # so a very long text needs its words only
        part = np.fromiter(islice(hashes, CHUNK), np.uint64, min(CHUNK, total - at))
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, bits) of every row; bits as a signed long."""

    def run(batches):
        for batch in batches:
            values = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", width) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(values, np.uint64).view(np.int64))], names=["doc_id", "bits"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return texts.mapInArrow(run, "doc_id long, bits long")


def flips(half: int) -> list[int]:
    """All sets of at most half of 64 bits, as signed longs; the empty one first."""
    masks = [sum(1 << i for i in chosen) for size in range(half + 1) for chosen in combinations(range(64), size)]
    return np.array(masks, np.uint64).view(np.int64).tolist()


def linked(distinct: DataFrame, half: int) -> DataFrame:
    """(a, b): links between distinct (bits) that connect all within 2 * half differing bits, a < b."""
    masks = F.array(*(F.lit(m) for m in flips(half)))
    met = distinct.select("bits", F.explode(masks).alias("mask"))
    met = met.select("bits", F.col("bits").bitwiseXOR(F.col("mask")).alias("variant"))
    met = met.select(F.min("bits").over(Window.partitionBy("variant")).alias("a"), F.col("bits").alias("b"))
    pairs = met.where("a < b").distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2 * half)


def near_duplicates(
    docs: DataFrame, width: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id.

    radius: an even number of differing bits, as two balls of half of it have to meet."""
    if radius < 0 or radius % 2:
        raise ValueError(f"radius {radius} is not an even number")
    rows = stored(fingerprints(docs, width, id_col, text_col))
    distinct = stored(rows.select("bits").distinct())
    several = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("bits").alias("a"), F.max("bits").alias("b"))
    several = several.where("a < b").select("doc_id", "a")
    same = rows.join(several, "doc_id").select("a", F.col("bits").alias("b")).where("a < b").distinct()
    roots = components(linked(distinct, radius // 2).unionAll(same))
    roots = rows.groupBy("bits").agg(F.min("doc_id").alias("least")).join(roots.withColumnRenamed("node", "bits"), "bits", "left")
    roots = roots.select("bits", F.coalesce("root", "bits").alias("root"), "least")
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    # stored, so that both sides of the last join are plain exchanges and a hot fingerprint can be split
    named = stored(roots.select("bits", "root").join(least, "root").select("bits", "component_id"))
    return rows.join(named, "bits").select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")
