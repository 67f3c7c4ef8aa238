"""Broker topics through Spark's Kafka source and sink.

The option builders are plain functions, so that they can be checked without the connector.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def subscribe_options(
    servers: str, topics: Sequence[str], max_offsets: int | None = None, **extra: str
) -> dict[str, str]:
    """Whole topics from the earliest offset; ``max_offsets`` limits one micro-batch."""
    return _with_rate(
        {
            "kafka.bootstrap.servers": servers,
            "subscribe": ",".join(topics),
            "startingOffsets": "earliest",
            **extra,
        },
        max_offsets,
    )


def assign_options(
    servers: str, partitions: Mapping[str, Sequence[int]], max_offsets: int | None = None, **extra: str
) -> dict[str, str]:
    """Listed partitions only."""
    chosen = {topic: sorted(numbers) for topic, numbers in sorted(partitions.items())}
    return _with_rate(
        {
            "kafka.bootstrap.servers": servers,
            "assign": json.dumps(chosen),
            "startingOffsets": "earliest",
            **extra,
        },
        max_offsets,
    )


def _with_rate(options: dict[str, str], max_offsets: int | None) -> dict[str, str]:
    if max_offsets:
        options["maxOffsetsPerTrigger"] = str(max_offsets)
    return options


def cluster_options(cluster: Mapping) -> dict[str, str]:
    """Options of one configured cluster: bootstrap_servers plus topics or partitions."""
    servers = cluster["bootstrap_servers"]
    servers = servers if isinstance(servers, str) else ",".join(servers)
    if cluster.get("partitions"):
        return assign_options(servers, cluster["partitions"], cluster.get("max_offsets"))
    return subscribe_options(servers, cluster["topics"], cluster.get("max_offsets"))


def read_topics(spark: SparkSession, options: Mapping[str, str], stream: bool = True) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return reader.format("kafka").options(**options).load()


def read_clusters(spark: SparkSession, clusters: Mapping[str, Mapping], stream: bool = True) -> DataFrame:
    """All clusters as one frame, each row naming its cluster."""
    return united({name: read_topics(spark, cluster_options(c), stream) for name, c in clusters.items()})


def united(clusters: Mapping[str, DataFrame]) -> DataFrame:
    """Frames of several clusters as one, each row naming its cluster."""
    return union_all(frame.withColumn("cluster", F.lit(name)) for name, frame in clusters.items())


def union_all(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def topic_sink_options(servers: str, topic: str) -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "topic": topic, "includeHeaders": "true"}


def write_topic(df: DataFrame, servers: str, topic: str) -> None:
    """Append (value, headers) rows to a topic."""
    df.write.format("kafka").options(**topic_sink_options(servers, topic)).save()
