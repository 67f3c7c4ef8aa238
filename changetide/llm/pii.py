"""Personal data: fixed kinds by pattern, further identifiers by bootstrapped contexts.

The fixed kinds (email, ip, card, phone) are leftmost non-overlapping matches, of which those that
fail their check are dropped. They seed a graph between lexical patterns and instances: an instance
is the value of a fixed match or of an identifier-like run of characters, and its patterns are the
word and the two words before it. In each round a pattern scores the mean score of the distinct
values it extracts, times the share of its occurrences in the whole corpus that an instance follows
("the" is followed by many things, "passport" by few); an instance scores how likely one at least of
its confident patterns is right. Values that end above the threshold are spans of the kind context,
wherever they stand. Patterns need a number of distinct values with a high score.

Everything is DataFrame functions. Text stays where it is read: only matches with a few characters
of context are shuffled, keyed by two hashes of the row, so equal rows share their matches. Null and
empty texts have no spans. Positions are code points. Matches of one document are laid out by window
functions, which spill; one row of the result holds all spans of a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changetide.llm.scratch import columns_of, stored

# The kinds and what makes a match of each; lookarounds keep runs from being tried twice.
KINDS = ("email", "ip", "card", "phone")
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# An unbroken run of these characters that holds a digit may be an identifier.
RUN = r"(?<![A-Za-z0-9_./@+-])(?=[A-Za-z_./@+-]*+[0-9])[A-Za-z0-9_./@+-]++"
WHITE = r"\x20\x09-\x0D"

BROADCAST_PATTERNS = 100_000


def luhn(digits: Column) -> Column:
    """Is the check digit right? From the right, every second digit counts twice, less nine above nine."""
    reversed_digits = F.split(F.reverse(digits), "")
    counted = F.transform(
        reversed_digits,
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)
        ),
    )
    return F.aggregate(counted, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    # compared as digits without leading zeros: a part may be too long for a number
    part = F.regexp_replace(value, r"(?<![0-9])0+(?=[0-9])", "")
    ip = ~F.exists(F.split(part, r"\."), lambda p: (F.length(p) > 3) | (F.lpad(p, 3, "0") > "255"))
    phone = F.length(digits).between(9, 15)
    run = (F.length(value) >= 5) & (F.length(digits) >= 3)
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", ip)
        .when(kind == "card", luhn(digits))
        .when(kind == "phone", phone)
        .otherwise(run)
    )


def row_keys(id_col: str, text_col: str) -> list[Column]:
    """Two hashes of what a row holds; together they identify it."""
    text, key = F.col(text_col).cast("string"), F.col(id_col)
    return [F.xxhash64(key, text).alias("h1"), F.xxhash64(F.lit(7), text, key).alias("h2")]


def matches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(h1, h2, kind, start, end, value, before) of all valid matches and identifier-like runs."""
    text = F.col("text")
    digit = text.rlike("[0-9]")
    probes = (
        ("email", EMAIL, F.contains(text, F.lit("@"))),
        ("ip", IP, text.rlike(r"[0-9]\.[0-9]")),
        ("card", CARD, text.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9]")),
        ("phone", PHONE, text.rlike(r"\+[0-9]")),
        ("run", RUN, digit),
    )
    laid = [
        F.struct(
            F.lit(kind).alias("kind"),
            F.when(
                probe,
                F.arrays_zip(
                    F.split(text, pattern, -1).alias("gap"),
                    F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"),
                ),
            ).alias("z"),
        )
        for kind, pattern, probe in probes
    ]
    rows = docs.select(*row_keys(id_col, text_col), F.col(text_col).cast("string").alias("text"))
    rows = rows.where(text.rlike("[0-9@]"))
    rows = rows.select("h1", "h2", F.inline(F.array(*laid))).where(F.size("z") > 1)
    rows = rows.select("h1", "h2", "kind", F.posexplode("z").alias("i", "hit")).where("hit.value is not null")
    rows = rows.select(
        "h1",
        "h2",
        "kind",
        "i",
        F.char_length("hit.gap").cast("long").alias("gap"),
        F.col("hit.value").alias("value"),
        F.lower(F.substring("hit.gap", -64, 64)).alias("before"),
    )
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "h1", "h2").dropDuplicates(["h1", "h2", "kind", "i"])
    order = Window.partitionBy("h1", "h2", "kind").orderBy("i")
    length = F.char_length("value")
    end = F.sum(F.col("gap") + length).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - length)
    # a run begins and ends with a letter or digit
    marks = F.lit("_./@+-")
    bare = F.ltrim("value", marks)
    lead = F.char_length("value") - F.char_length(bare)
    trim = F.col("kind") == "run"
    rows = rows.withColumn("start", F.when(trim, F.col("start") + lead).otherwise(F.col("start")))
    rows = rows.withColumn("value", F.when(trim, F.rtrim(bare, marks)).otherwise(F.col("value")))
    rows = rows.withColumn("end", F.when(trim, F.col("start") + F.char_length("value")).otherwise(F.col("end")))
    return rows.where(_valid(F.col("kind"), F.col("value"))).select(
        "h1", "h2", "kind", "start", "end", "value", "before"
    )


def _units(found: DataFrame) -> DataFrame:
    """Valid matches, and the runs that no match overlaps."""
    place = Window.partitionBy("h1", "h2").orderBy("start", "end")
    base = F.col("kind") != "run"
    reach = F.max(F.when(base, F.col("end"))).over(
        Window.partitionBy("h1", "h2").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    )
    coming = F.min(F.when(base, F.col("start"))).over(place.rowsBetween(1, Window.unboundedFollowing))
    marked = found.withColumn("reach", reach).withColumn("coming", coming)
    free = (F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.coalesce("coming", "end") >= F.col("end"))
    return marked.where(base | free).drop("reach", "coming")


def _patterns(units: DataFrame) -> DataFrame:
    """(pattern, value, seed) for every occurrence: one word and two words before it."""
    one = F.regexp_extract("before", rf"([^{WHITE}]+)[{WHITE}]*$", 1)
    two = F.regexp_replace(
        F.regexp_extract("before", rf"([^{WHITE}]+[{WHITE}]+[^{WHITE}]+)[{WHITE}]*$", 1), rf"[{WHITE}]+", " "
    )
    # a word that touches the instance is no word of its own; such a pattern ends with a blank
    gap = F.when(F.col("before").rlike(rf"[{WHITE}]$"), F.lit("")).otherwise(F.lit(" "))
    seed = (F.col("kind") != "run").alias("seed")
    edges = units.select(F.explode(F.array(one, two)).alias("pattern"), gap.alias("gap"), "value", seed)
    return edges.where("pattern <> ''").select(F.concat("pattern", "gap").alias("pattern"), "value", "seed")


def _followed(docs: DataFrame, text_col: str, patterns: DataFrame) -> DataFrame:
    """(pattern, total): how often each pattern's words stand anywhere in the corpus.

    Every word is laid out once, beside the one before it. Only words that end a pattern go on, so pairs
    are put together for these alone."""
    words = F.filter(F.split(F.lower(F.col(text_col).cast("string")), rf"[{WHITE}]+"), lambda w: w != "")
    rows = docs.select(words.alias("words")).where(F.size("words") > 0)
    beside = F.arrays_zip(
        F.concat(F.array(F.lit("")), F.slice("words", 1, F.size("words") - 1)).alias("before"), F.col("words").alias("word")
    )
    laid = rows.select(F.inline(beside))
    ends = patterns.select(F.element_at(F.split("pattern", " "), -1).alias("word")).distinct()
    few = patterns.count() <= BROADCAST_PATTERNS
    laid = laid.join(F.broadcast(ends) if few else ends, "word", "left_semi")
    pair = F.when(F.col("before") != "", F.concat_ws(" ", "before", "word"))
    spread = laid.select(F.explode(F.array("word", pair)).alias("pattern")).where("pattern is not null")
    if few:
        spread = spread.join(F.broadcast(patterns), "pattern", "left_semi")
        return spread.groupBy("pattern").agg(F.count("*").alias("total"))
    spread = spread.groupBy("pattern").agg(F.count("*").alias("n")).join(patterns, "pattern", "left_semi")
    return spread.select("pattern", F.col("n").alias("total"))


def discovered(
    docs: DataFrame,
    units: DataFrame,
    text_col: str,
    rounds: int,
    support: int,
    pattern_score: float,
    value_score: float,
) -> DataFrame:
    """(value): values outside the seeds that confident patterns extract."""
    edges = _patterns(units).groupBy("pattern", "value").agg(F.count("*").alias("n"), F.max("seed").alias("seed"))
    edges = stored(edges)
    sums = edges.groupBy("pattern").agg(
        F.sum("n").alias("units"), F.count("*").alias("held"), F.sum(F.col("seed").cast("long")).alias("seeds")
    )
    # only patterns that could pass if each value they extract were right, and one word of them a seed
    able = stored(sums.where((F.col("held") >= support) & (F.col("held") > F.col("seeds")) | (F.col("seeds") >= support)))
    wide = able.where(~F.col("pattern").endswith(" ")).select("pattern")
    totals = stored(_followed(docs, text_col, wide)) if not wide.isEmpty() else None
    if totals is None:
        share = able.select("pattern", F.lit(1.0).alias("share"))
    else:
        share = able.join(totals, "pattern", "left").select(
            "pattern", (F.col("units") / F.greatest(F.coalesce("total", "units"), F.col("units"))).alias("share")
        )
    graph = stored(edges.join(share.where(F.col("share") >= pattern_score), "pattern"))
    scores = stored(graph.groupBy("value").agg(F.max("seed").cast("double").alias("score")))
    for _ in range(rounds):
        high = F.col("score") >= value_score
        rated = (
            graph.join(scores, "value")
            .groupBy("pattern")
            .agg((F.avg("score") * F.first("share")).alias("rate"), F.sum(high.cast("long")).alias("good"))
            .where((F.col("rate") >= pattern_score) & (F.col("good") >= support))
        )
        wrong = F.greatest(1 - F.col("rate"), F.lit(1e-6))
        gained = graph.join(rated, "pattern").groupBy("value").agg((1 - F.exp(F.sum(F.log(wrong)))).alias("new"))
        scores = stored(
            scores.join(gained, "value", "left").select("value", F.greatest("score", F.coalesce("new", F.lit(0.0))).alias("score"))
        )
    return scores.where(F.col("score") >= value_score).select("value")


def findings(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rounds: int = 3,
    support: int = 3,
    pattern_score: float = 0.5,
    value_score: float = 0.5,
) -> DataFrame:
    """(h1, h2, kind, start, end, value) of all spans, of the fixed kinds and of the kind context."""
    units = stored(_units(matches(docs, id_col, text_col)))
    values = discovered(docs, units, text_col, rounds, support, pattern_score, value_score)
    kept = units.where("kind <> 'run'")
    added = units.where("kind = 'run'").join(values, "value", "left_semi").withColumn("kind", F.lit("context"))
    return kept.unionByName(added).drop("before")


def per_document(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id, counts of the fixed kinds and of context, and the spans as strings."""
    place = F.array_position(F.array(*map(F.lit, (*KINDS, "context"))), F.col("kind"))
    entry = F.struct(place.alias("k"), "start", "end", F.concat_ws(":", "kind", "start", "end").alias("text"))
    base = F.col("kind") != "context"
    listed = lambda c: F.array_join(F.transform(F.array_sort(c), lambda s: s["text"]), ",")
    grouped = spans.groupBy("h1", "h2").agg(
        *(F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in (*KINDS, "context")),
        F.collect_list(F.when(base, entry)).alias("base"),
        F.collect_list(entry).alias("every"),
    )
    grouped = grouped.withColumn("base", listed("base")).withColumn("every", listed("every"))
    rows = docs.select(F.col(id_col), *row_keys(id_col, text_col)).join(grouped, ["h1", "h2"], "left")
    return rows.select(
        id_col,
        *(F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("every", F.lit("")).alias("spans"),
        F.coalesce("n_context", F.lit(0)).cast("long").alias("n_context"),
    )


def redacted(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in brackets; overlapping spans count as one, of the first kind."""
    order = Window.partitionBy("h1", "h2").orderBy("start", F.col("end").desc(), "kind")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("start") < F.coalesce(before, F.lit(0)), 0).otherwise(1)
    grouped = spans.withColumn("opens", opens).withColumn("group", F.sum("opens").over(order))
    cuts = grouped.groupBy("h1", "h2", "group").agg(
        F.min("start").alias("s"), F.max("end").alias("e"), F.min(F.struct("start", "kind"))["kind"].alias("kind")
    )
    cuts = cuts.groupBy("h1", "h2").agg(F.array_sort(F.collect_list(F.struct("s", "e", "kind"))).alias("cuts"))
    text = F.col(text_col).cast("string")
    able = F.coalesce(text.rlike("[0-9@]"), F.lit(False))
    names = columns_of(docs)
    plain = docs.where(~able)
    keys = row_keys(id_col, text_col)
    held = docs.where(able).withColumns({"__h1": keys[0], "__h2": keys[1]})
    cuts = cuts.select(F.col("h1").alias("__h1"), F.col("h2").alias("__h2"), F.col("cuts").alias("__cuts"))
    held = held.join(cuts, ["__h1", "__h2"], "left")
    cut, at = F.col("__cuts"), F.col(text_col).cast("string")
    pieces = F.transform(
        cut,
        lambda c, i: F.concat(
            F.substring(at, (F.coalesce(F.get(cut, i - 1)["e"], F.lit(0)) + 1).cast("int"),
                        (c["s"] - F.coalesce(F.get(cut, i - 1)["e"], F.lit(0))).cast("int")),
            F.lit("["), F.upper(c["kind"]), F.lit("]"),
        ),
    )
    tail = F.substring(at, (F.element_at(cut, -1)["e"] + 1).cast("int"), F.char_length(at))
    held = held.withColumn(
        text_col, F.when(cut.isNotNull(), F.concat(F.array_join(pieces, ""), tail)).otherwise(F.col(text_col))
    )
    return plain.select(names).unionByName(held.select(names))
