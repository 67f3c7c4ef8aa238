"""Quality rules as a ledger of bits.

Each document is measured once, and every rule is evaluated once on the measurements: bit i of
`failures` says that rule i fails. A policy is a version with the rules it enforces; applying it is
one mask. How many documents a rule takes out on its own, or how many more another version keeps,
are sums over the few distinct masks and need no second look at any text.

Null and empty texts have no words and fail few_words. Repeated rows give repeated rows. Texts of any
length are measured whole, in memory proportional to one text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changetide.llm.words import windows, word_hashes

SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

# rule i is bit i; rules are only ever added at the end, so stored ledgers stay readable
RULES = (
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
)
BASE = ("few_words", "repeated_windows")
POLICIES = {1: BASE, 2: tuple(name for name, _ in RULES)}
CURRENT = 2


def bit(name: str) -> int:
    return 1 << [rule for rule, _ in RULES].index(name)


def mask(names) -> int:
    return sum(bit(name) for name in names)


def measured(text: str | None) -> tuple[int, ...]:
    data = (text or "").encode("utf-8", "surrogatepass")
    words = word_hashes(data)
    bare = data.translate(None, b" \t\n\r\x0b\x0c")
    chars = int(np.count_nonzero(np.frombuffer(bare, np.uint8) & 0xC0 != 0x80))
    lines = [line for line in data.split(b"\n") if line.strip(b" \t\n\r\x0b\x0c")]
    covered = 0
    threes = windows(words, 3)
    if len(threes):
        order = np.argsort(threes, kind="stable")
        ranked = threes[order]
        same = ranked[1:] == ranked[:-1]
        if same.any():
            twice = np.zeros(len(threes) + 2, bool)
            found = np.zeros(len(threes), bool)
            found[1:] |= same
            found[:-1] |= same
            at = order[found]
            for step in range(3):
                twice[at + step] = True
            covered = int(twice.sum())
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    return len(words), chars, symbols, len(lines), len(lines) - len(set(lines)), covered


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, all measurements (long) and failures (long, one bit for each rule) of every row."""

    def run(batches):
        for batch in batches:
            rows = [measured(text) for text in batch.column(1).to_pylist()]
            columns = zip(*rows) if rows else [[]] * len(MEASURES)
            arrays = [pa.array(c, pa.int64()) for c in columns]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[id_col, *MEASURES])

    key = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    rows = rows.mapInArrow(run, f"`{id_col}` {key}, " + ", ".join(f"{m} long" for m in MEASURES))
    failures = F.lit(0).cast("long")
    for name, rule in RULES:
        failures = failures.bitwiseOR(F.when(F.expr(rule), F.lit(bit(name))).otherwise(0).cast("long"))
    return rows.withColumn("failures", failures)


def kept(failures: Column, version: int = CURRENT) -> Column:
    return failures.bitwiseAND(F.lit(mask(POLICIES[version])).cast("long")) == 0


def judged(docs: DataFrame, version: int = CURRENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger with base_failed and the verdict of a policy."""
    rows = ledger(docs, id_col, text_col)
    failures = F.col("failures")
    base = failures.bitwiseAND(F.lit(mask(BASE)).cast("long")) != 0
    return rows.withColumn("base_failed", base).withColumn("kept", ~base & kept(failures, version))


def ablations(rows: DataFrame, version: int = CURRENT) -> DataFrame:
    """For each rule of a policy: documents that fail it, that only it takes out, and that would be
    kept without it; from counts by mask."""
    names = POLICIES[version]
    whole = mask(names)
    masks = rows.groupBy(F.col("failures").bitwiseAND(F.lit(whole).cast("long")).alias("m")).agg(F.count("*").alias("n"))
    rule = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(bit(n)).cast("long").alias("bit")) for n in names)))
    spread = masks.select("m", "n", rule.alias("r")).select("m", "n", "r.rule", "r.bit")
    fails, rest = F.col("m").bitwiseAND(F.col("bit")) != 0, F.col("m").bitwiseAND(F.bitwise_not("bit")) == 0
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return spread.groupBy("rule").agg(
        total(fails).alias("failed"), total(fails & rest).alias("failed_alone"), total(rest).alias("kept_without")
    )
