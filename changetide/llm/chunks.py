"""Repeated passages by content-defined chunks.

A gear hash rolls over the bytes of a text; where its high bits are zero, a chunk ends. So borders
follow the content and meet again soon after an insertion. Chunks are deduplicated over the whole
corpus by digest: its first place in the document of the smallest id keeps a chunk, all others are
copies. Adjacent copies in one text join to a span, and spans of min_span bytes or more are
reported. A passage that repeats loses a part of a chunk at either end, 32 bytes each on average, so
passages of 50 words stay well above that, and single lines below.

Null and empty texts have no chunks. Rows that repeat a whole row are one occurrence. Rows without an
id take no part. Offsets are code points. Chunks are counted by digest with partial sums, and the
join back is a sorted one that splits skewed keys, so a passage in every document is no hot spot.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changetide.llm.scratch import columns_of
from xxhash import xxh3_128_intdigest

BITS = 5
LEAST, MOST = 4, 256
SLICE = 1 << 24
GEAR = np.random.default_rng(3).integers(0, 1 << 32, 256, np.uint32)


def rolling(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte, of the 32 bytes up to it: sums of shifted table values, by doubling."""
    total = GEAR[data]
    width = 1
    while width < 32:
        total[width:] += total[:-width] << np.uint32(width)
        width *= 2
    return total


def borders(data: bytes) -> list[int]:
    """Ends of the chunks of a text, between characters."""
    size, ends, last = len(data), [], 0
    for at in range(0, size, SLICE):  # each slice with the 31 bytes before it
        lead = min(at, 31)
        part = np.frombuffer(data, np.uint8, min(size - at, SLICE) + lead, at - lead)
        cut = (rolling(part) >> np.uint32(32 - BITS) == 0)[lead:]
        for place in np.flatnonzero(cut).tolist():
            end = at + place + 1
            while end - last > MOST:
                last = _whole(data, last + MOST)
                ends.append(last)
            if end - last >= LEAST and end < size and data[end] & 0xC0 != 0x80:
                ends.append(end)
                last = end
    while size - last > MOST:
        last = _whole(data, last + MOST)
        ends.append(last)
    if size > last:
        ends.append(size)
    return ends


def _whole(data: bytes, end: int) -> int:
    while data[end] & 0xC0 == 0x80:
        end -= 1
    return end


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, d1, d2, start, end, n_bytes, again) of all chunks; d1, d2: 96 bits of the digest; again:
    the text had that chunk before."""

    def run(batches):
        for batch in batches:
            held: tuple = tuple([] for _ in range(7))
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = text.encode("utf-8", "surrogatepass")
                places = borders(data)
                if not places:
                    continue
                cuts = [0, *places]
                digests = [xxh3_128_intdigest(data[a:b]) for a, b in zip(cuts, places)]
                seen: set[int] = set()
                again = [d in seen or seen.add(d) is not None for d in digests]
                marks = np.cumsum(np.frombuffer(data, np.uint8) & 0xC0 != 0x80)[np.array(places) - 1]
                columns = (
                    np.full(len(places), key),
                    np.array([d >> 64 for d in digests], np.uint64).view(np.int64),
                    np.array([d & 0xFFFFFFFF for d in digests], np.uint32).view(np.int32),
                    np.concatenate([[0], marks[:-1]]),
                    marks,
                    np.diff(cuts),
                    np.array(again, np.bool_),
                )
                for column, more in zip(held, columns):
                    column.append(more)
                if sum(map(len, held[0])) > 100_000:
                    yield batch_of(held)
                    held = tuple([] for _ in range(7))
            if held[0]:
                yield batch_of(held)

    def batch_of(columns):
        kinds = pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()
        arrays = [pa.array(np.concatenate(c), k, safe=False) for c, k in zip(columns, kinds)]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "d1", "d2", "start", "end", "n_bytes", "again"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where("doc_id is not null and text is not null")
    return rows.mapInArrow(run, "doc_id long, d1 long, d2 int, start int, end int, n_bytes int, again boolean")


def repeated(docs: DataFrame, min_span: int = 96, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, end, n_bytes, n_chunks, first_doc_ids) of every span that repeats earlier text."""
    every = chunks(docs, id_col, text_col)  # cut twice rather than stored: the chunks outweigh the texts
    held = every.groupBy("d1", "d2").agg(
        F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last"), F.max("again").alias("twice")
    )
    held = held.where("first_doc_id < last or twice").select("d1", "d2", "first_doc_id")
    copies = every.join(held, ["d1", "d2"]).where("doc_id <> first_doc_id or again")
    copies = copies.select("doc_id", "start", "end", "n_bytes", "first_doc_id").distinct()
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    copies = copies.withColumn("opens", F.when(before >= F.col("start"), 0).otherwise(1))
    copies = copies.withColumn("span", F.sum("opens").over(order))
    spans = copies.groupBy("doc_id", "span").agg(
        F.min("start").cast("long").alias("start"),
        F.max("end").cast("long").alias("end"),
        F.sum("n_bytes").alias("n_bytes"),
        F.count("*").alias("n_chunks"),
        F.array_sort(F.collect_set("first_doc_id")).alias("first_doc_ids"),
    )
    return spans.where(F.col("n_bytes") >= min_span).drop("span")


def without(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the spans taken out of their texts; columns and other rows as they are."""
    cuts = spans.groupBy(F.col("doc_id").alias("__id")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__cuts"))
    joined = docs.join(cuts, F.col(id_col).cast("long") == F.col("__id"), "left")
    text, cut = F.col(text_col).cast("string"), F.col("__cuts")
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(cut, lambda c: c["end"]))
    starts = F.concat(F.transform(cut, lambda c: c["start"]), F.array(F.char_length(text).cast("long")))
    kept = F.transform(
        F.arrays_zip(ends.alias("a"), starts.alias("b")),
        lambda z: F.substring(text, (z["a"] + 1).cast("int"), (z["b"] - z["a"]).cast("int")),
    )
    cleaned = F.when(cut.isNull(), F.col(text_col)).otherwise(F.array_join(kept, ""))
    return joined.withColumn(text_col, cleaned).select(columns_of(docs))
