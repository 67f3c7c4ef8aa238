"""Live feed rows, their recipients and signed outbound deliveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changetide.functions import present, signing
from changetide.functions import values as V

EVERYTHING = "*"
USER_AGENT = "changetide/1.0"


def feed_rows(events: DataFrame) -> DataFrame:
    """Each event as a ``new_event`` message."""
    message = F.struct(
        F.lit("new_event").alias("type"),
        F.struct(
            F.struct("topic", "partition", "offset").alias("id"),
            "event_type",
            present.iso_text(F.col("event_time")).alias("event_time"),
            "user_id",
            "service_name",
            "operation",
            F.col("table_id").alias("source_table_id"),
            V.parse_json(F.col("row_identity")).alias("row_identity"),
            "event_data",
        ).alias("event"),
    )
    return events.select(
        "topic",
        "partition",
        "offset",
        "service_name",
        F.to_json(message, {"ignoreNullFields": "false"}).alias("body"),
    )


def feed_for(feed: DataFrame, tenant: str | None) -> DataFrame:
    """The feed one subscriber sees; no tenant sees all."""
    return feed if tenant is None else feed.where(F.col("service_name") == tenant)


def _channels(feed: DataFrame, subscriptions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Listeners with their channel, and the rows with each channel somebody may listen to."""
    listeners = subscriptions.withColumn("channel", F.coalesce("tenant", F.lit(EVERYTHING))).drop("tenant")
    catch_all = not subscriptions.where("tenant is null").isEmpty()
    names = [F.col("service_name")] + [F.lit(EVERYTHING)] * catch_all
    return listeners, feed.withColumn("channel", F.explode(F.array(*names)))


def fan_out(feed: DataFrame, subscriptions: DataFrame, rows_per_salt: int = 1_000_000) -> DataFrame:
    """One row per (subscriber, event).

    A channel is cut into as many salts as its volume asks for, so a hot service and the catch-all
    channel spread over tasks; the catch-all is offered only if somebody listens to it.
    ``subscriptions`` has columns subscriber and tenant (NULL for everything). The result is as
    large as all deliveries; use ``fan_out_totals`` or ``feed_for`` where that is not wanted.
    """
    listeners, offers = _channels(feed, subscriptions)
    volume = offers.groupBy("channel").agg(F.ceil(F.count(F.lit(1)) / rows_per_salt).cast("int").alias("salts"))
    heard = listeners.join(volume, "channel")
    spread = heard.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    # cheap and even: any value below a channel's number of salts will do
    dealt = F.pmod(F.xxhash64("topic", "partition", "offset"), F.col("salts")).cast("int")
    salted = offers.join(volume, "channel").withColumn("salt", dealt).drop("salts")
    return salted.join(spread.drop("salts"), ["channel", "salt"]).drop("channel", "salt")


def fan_out_totals(feed: DataFrame, subscriptions: DataFrame, totals: dict[str, Column]) -> DataFrame:
    """Sums over what each subscriber gets, from sums per channel."""
    listeners, offers = _channels(feed, subscriptions)
    summed = offers.groupBy("channel").agg(*(c.alias(n) for n, c in totals.items()))
    return listeners.join(summed, "channel").drop("channel")


def distinct_feed(feed: DataFrame) -> DataFrame:
    """Drop messages a reader has already seen."""
    return feed.dropDuplicates(["topic", "partition", "offset"])


def notified_events(events: DataFrame, notices: DataFrame) -> DataFrame:
    """Stored events named by a table of notified positions."""
    return events.join(notices, ["topic", "partition", "offset"], "left_semi")


def deliveries(feed: DataFrame, secret: str | None = None) -> DataFrame:
    """Bodies with their headers, ready to be posted."""
    headers = [
        F.lit("Content-Type"), F.lit("application/json"), F.lit("User-Agent"), F.lit(USER_AGENT),
    ]
    if secret:
        headers += [
            F.lit("X-Signature"),
            F.concat(F.lit("sha256="), signing.hmac_sha256(F.col("body"), secret)),
        ]
    return feed.withColumn("headers", F.create_map(*headers))
