"""Near-duplicate documents by MinHash with tensored banding.

Two small collections of pieces are computed for each text, each piece a few minhashes long. A
table's key joins one piece of the left and one of the right collection, so m + m pieces serve
m * m tables. A table can only bring two texts together if they share its left and its right piece;
therefore pieces without a second holder are dropped before any key is formed. Texts with equal
shingle sets are one class from the start and are sketched and compared once.

Candidates are confirmed on full shingle sets, in three steps that together cover every pair of
one bucket: each class against the most popular class it shares a bucket with, each class against
the most popular class of every bucket, and then the pairs of a bucket that are not connected yet.
Of the last, those are left out that cannot reach the threshold: classes with too many shingles of
their own, and pairs whose sizes or odd sketches differ by too much. These tests are bounds, not
estimates. So a big group of copies costs a comparison per copy, and no link between unconnected
texts is left out. Two texts at the threshold 0.8 share a bucket with a probability of 0.9998, closer ones nearly
always.

Null or wordless texts have empty sets and link with nothing. A text of fewer words than a shingle
is one shingle. Repeated rows give repeated rows of one document; rows of one id with different
texts link whatever any of them links. Rows without an id are returned with a null component and kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from changetide.llm.components import components
from changetide.llm.scratch import columns_of, stored
from changetide.llm.words import mixed, shingle_set, slices

CHUNK = 4096
ODD_WORDS = 32


def _draws(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    top = np.iinfo(np.uint64).max
    return (
        rng.integers(0, top, count, np.uint64, endpoint=True) | np.uint64(1),
        rng.integers(0, top, count, np.uint64, endpoint=True),
    )


def pieces(shingles: np.ndarray, factors: np.ndarray, shifts: np.ndarray, piece: int) -> np.ndarray:
    """The minhashes of a set, so many joined to a piece; pieces of different places never meet."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), CHUNK):
        part = shingles[at : at + CHUNK]
        np.minimum(least, (part[None, :] * factors[:, None] + shifts[:, None]).min(axis=1), out=least)
    out = np.arange(len(factors) // piece, dtype=np.uint64)
    for column in mixed(least).reshape(-1, piece).T:
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out


def _digest(shingles: np.ndarray) -> tuple[int, int]:
    high, low = np.frombuffer(xxh3_128_digest(shingles.tobytes()), np.int64)
    return int(high), int(low)


def odd_sketch(shingles: np.ndarray) -> np.ndarray:
    """One bit for each place, set if an odd number of shingles falls there. The bits in which two
    sketches differ are never more than the shingles in which the sets differ."""
    held = np.bincount(shingles & np.uint64(64 * ODD_WORDS - 1), minlength=64 * ODD_WORDS) & 1
    return np.packbits(held.astype(np.uint8), bitorder="little").view(np.int64)


def sketches(docs: DataFrame, width: int, m: int, piece: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, left_pieces, right_pieces) of every row; d1, d2: digest of the set."""
    factors, shifts = _draws(2 * m * piece, seed)

    def run(batches):
        for batch in slices(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                found = shingle_set(text, width)
                own = pieces(found, factors, shifts, piece).view(np.int64) if len(found) else np.empty(0, np.int64)
                rows.append((len(found), *_digest(found), own[:m], own[m:]))
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            arrays = [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_shingles", "d1", "d2", "l", "r"])

    frame = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, n_shingles long, d1 long, d2 long, l array<long>, r array<long>"
    return frame.mapInArrow(run, schema)


def _sets(docs: DataFrame, needed: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(rep, d1, d2, n, shingles, odd) of the classes needed: (rep, d1, d2); n: the number of shingles."""

    def run(batches):
        for batch in slices(batches):
            found = [shingle_set(text, width) for text in batch.column(1).to_pylist()]
            digests = [_digest(f) for f in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([d[0] for d in digests], pa.int64()),
                    pa.array([d[1] for d in digests], pa.int64()),
                    pa.array([len(f) for f in found], pa.int64()),
                    pa.array([f.view(np.int64) for f in found], pa.list_(pa.int64())),
                    pa.array([odd_sketch(f) for f in found], pa.list_(pa.int64())),
                ],
                names=["rep", "d1", "d2", "n", "shingles", "odd"],
            )

    frame = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).cast("string").alias("text"))
    frame = frame.join(needed.select("rep").distinct(), "rep", "left_semi").select("rep", "text")
    sets = frame.mapInArrow(run, "rep long, d1 long, d2 long, n long, shingles array<long>, odd array<long>")
    return sets.join(needed, ["rep", "d1", "d2"], "left_semi").dropDuplicates(["rep", "d1", "d2"])


def _able(a: str, b: str, percent: int) -> Column:
    """Can the sets of two rows with columns <prefix>n and <prefix>odd be similar enough? By their sizes, and by
    their odd sketches, whose difference is a lower bound of theirs; never wrong where it says no."""
    differ = sum(
        (F.bit_count(F.get(a + "odd", F.lit(i)).bitwiseXOR(F.get(b + "odd", F.lit(i)))) for i in range(ODD_WORDS)), F.lit(0)
    )
    least, most = F.least(a + "n", b + "n"), F.greatest(a + "n", b + "n")
    return (100 * least >= percent * most) & (differ * (100 + percent) <= (least + most) * (100 - percent))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose sets are similar enough; shingles are compared where sizes and odd
    sketches leave it open."""
    held = {
        side: sets.select(F.col("rep").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in ("n", "odd", "shingles")))
        for side in "ab"
    }
    joined = pairs.join(held["a"], "a").join(held["b"], "b").where(_able("a_", "b_", percent))
    both = F.size(F.array_intersect("a_shingles", "b_shingles"))
    either = F.col("a_n") + F.col("b_n") - F.col("both")
    return (
        joined.withColumn("both", both).where(100 * F.col("both") >= percent * either).select("a", "b").distinct()
    )


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def buckets(reps: DataFrame, m: int) -> DataFrame:
    """(key, rep, popular): classes in table buckets of two or more; popular: how widely its pieces are held."""
    single = reps.select("rep", F.explode(F.concat("l", "r")).alias("value"))
    held = single.groupBy("value").agg(F.count("*").alias("holders"), F.min("rep").alias("lo"), F.max("rep").alias("hi"))
    held = held.where("lo < hi").select("value", "holders")
    left = reps.select("rep", F.explode("l").alias("value"), F.lit(True).alias("is_left"))
    right = reps.select("rep", F.explode("r").alias("value"), F.lit(False).alias("is_left"))
    shared = (
        left.unionAll(right)
        .join(held, "value")
        .groupBy("rep")
        .agg(
            F.collect_set(F.when(F.col("is_left"), F.col("value"))).alias("ls"),  # m values at most
            F.collect_set(F.when(~F.col("is_left"), F.col("value"))).alias("rs"),
            F.sum("holders").alias("popular"),
        )
    )
    keys = shared.select("rep", "popular", F.explode("ls").alias("x"), "rs").select(
        "rep", "popular", "x", F.explode("rs").alias("y")
    )
    entries = stored(keys.select(F.xxhash64("x", "y").alias("key"), "rep", "popular"))
    full = entries.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi")
    return stored(entries.join(full.select("key"), "key"))


def _labelled(members: DataFrame, roots: DataFrame, node: str, name: str) -> DataFrame:
    named = roots.select(F.col("node").alias(node), F.col("root").alias("_root"))
    return members.join(named, node, "left").withColumn(name, F.coalesce("_root", node)).drop("_root")


def linked_classes(members: DataFrame, reps: DataFrame, sets: DataFrame, same: DataFrame, percent: int) -> DataFrame:
    """(node, root) over classes that are linked within the buckets, or by same (a, b)."""
    # the more popular first, then the smaller id
    first = F.struct(F.col("popular"), F.bitwise_not("rep").alias("back"))
    best = members.groupBy("key").agg(F.max(first).alias("top"))
    starred = stored(
        members.join(best.select("key", F.bitwise_not("top.back").alias("hub"), F.col("top.popular").alias("p")), "key")
    )

    hub = F.max(F.struct("p", F.bitwise_not("hub").alias("back")))
    one = starred.where("hub <> rep").groupBy("rep").agg(hub.alias("top"))
    tried = stored(_ordered(one.select(F.col("rep").alias("a"), F.bitwise_not("top.back").alias("b"))))
    edges = stored(_confirmed(tried, sets, percent).unionAll(same))
    roots = components(edges)

    apart = _labelled(_labelled(starred.where("hub <> rep"), roots, "rep", "rl"), roots, "hub", "hl").where("rl <> hl")
    second = stored(
        _ordered(apart.select(F.col("rep").alias("a"), F.col("hub").alias("b"))).join(tried, ["a", "b"], "left_anti")
    )
    found = stored(_confirmed(second, sets, percent))
    if not found.isEmpty():
        roots = components(roots.toDF("a", "b").unionAll(found))

    named = _labelled(starred.select("key", "rep"), roots, "rep", "label")
    able = _linkable(_mixed(named).select("rep").distinct(), sets, percent)
    able = _labelled(able.join(reps.select("rep", "d1", "d2", "l"), ["rep", "d1", "d2"]), roots, "rep", "label")
    third = _near_enough(able, percent)
    third = stored(_ordered(third).join(tried.unionAll(second), ["a", "b"], "left_anti"))
    found = stored(_confirmed(third, sets, percent))
    return roots if found.isEmpty() else components(roots.toDF("a", "b").unionAll(found))


def _mixed(named: DataFrame) -> DataFrame:
    """The rows of buckets that hold several labels, with the most frequent one as main."""
    counts = named.groupBy("key", "label").agg(F.count("*").alias("n"))
    main = counts.groupBy("key").agg(F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("labels"))
    main = main.where("labels > 1").select("key", F.col("top.label").alias("main"))
    return named.join(main, "key")


def _linkable(reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(rep, d1, d2, n, odd) of the classes among reps that can link with another of them at all.

    A shingle that no other set holds can't be shared, and a set with too many of these has no
    partner. This settles the members of a big group that were changed too much to be near anyone."""
    key = ["d1", "d2"]
    own = stored(sets.join(reps, "rep", "left_semi"))
    held = own.select(*key, F.explode("shingles").alias("s")).groupBy("s")
    held = held.agg(F.count("*").alias("sets"), F.min("d1").alias("d1"), F.min("d2").alias("d2"))
    alone = held.where("sets = 1").groupBy(*key).agg(F.count("*").alias("alone"))
    able = own.drop("shingles").join(alone, key, "left")
    return able.where(f"100 * (n - coalesce(alone, 0)) >= {percent} * n").drop("alone")


def _near_enough(able: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different labels that share a left piece and that neither the sizes nor the odd
    sketches rule out, each once, at the first piece they share.

    Whoever meets in a table shares a left piece. Sets link if they differ in no more than
    (100 - percent) / (100 + percent) of their sizes' sum, and the sketches' difference is a lower
    bound of theirs; so members of a big group are compared by a few machine words, and only pairs
    close to the threshold come out."""
    rows = _mixed(stored(able.withColumn("key", F.explode("l"))))
    few, rest = (
        rows.select("key", "main", *(F.col(c).alias(f"{side}_{c}") for c in ("rep", "label", "n", "odd", "l")))
        for side in ("a", "b")
    )
    few, rest = few.where("a_label <> main"), rest.drop("main")
    near = (
        F.expr("a_label <> b_label and (b_label = main or a_rep < b_rep)")
        & _able("a_", "b_", percent)
        & (F.get(F.array_intersect("a_l", "b_l"), F.lit(0)) == F.col("key"))
    )
    return few.join(rest, "key").where(near).select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b"))


def near_duplicates(
    docs: DataFrame,
    width: int = 4,
    percent: int = 80,
    m: int = 9,
    piece: int = 2,
    seed: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept."""
    found = stored(sketches(docs, width, m, piece, seed, id_col, text_col))
    full = found.where("n_shingles > 0 and doc_id is not null")
    classes = stored(full.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")))
    # all rows of a class hold the same pieces, so any row of its first document serves
    first = full.select(F.col("doc_id").alias("rep"), "d1", "d2", "l", "r")
    reps = first.join(classes, ["rep", "d1", "d2"], "left_semi").dropDuplicates(["rep", "d1", "d2"])
    reps = stored(reps)
    members = buckets(reps, m)
    needed = reps.join(members.select("rep").distinct(), "rep", "left_semi").select("rep", "d1", "d2")
    sets = stored(_sets(docs, needed, width, id_col, text_col))
    classed = stored(found.select("doc_id", "n_shingles", "d1", "d2").join(classes, ["d1", "d2"], "left"))
    split = classed.where("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b"))
    split = split.where("a < b").select("doc_id", "a")
    same = classed.join(split, "doc_id").select("a", F.col("rep").alias("b")).where("a < b").distinct()
    roots = linked_classes(members, reps, sets, same, percent)
    named = _labelled(classed, roots, "rep", "root")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return named.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each group of near duplicates, with the columns of docs.

    Rows without an id are documents by their text, so they link like others and equal ones are one.
    Of a group the document with the smallest id stays, one without an id only if none has one; of
    its rows, the one with the longest text."""
    text, own_columns = F.col(text_col).cast("string"), columns_of(docs)
    # ids of their own for rows without one, in [2^62, 2^63), above the usual ids
    own = F.xxhash64(text).bitwiseAND(F.lit(2**62 - 1)) + F.lit(2**62)
    keyed = docs.withColumn("__key", F.coalesce(F.col(id_col).cast("long"), own))
    near = near_duplicates(keyed, id_col="__key", text_col=text_col)
    # a wordless row of a document is alone in its component; the document's other rows tell its group
    kept = near.groupBy(F.col("doc_id").alias("__key")).agg(F.min("component_id").alias("root")).where("root = __key")
    order = F.struct(F.coalesce(F.char_length(F.trim(text)), F.lit(-1)), F.xxhash64(F.to_json(F.struct(*own_columns))))
    # a repeated row becomes one in each task that reads it, before rows are dealt out by key
    rows = keyed.groupBy("__key").agg(F.max_by(F.struct(*own_columns), order).alias("__row"))
    return rows.join(kept.select("__key"), "__key", "left_semi").select("__row.*")
