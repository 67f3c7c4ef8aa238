"""Session settings every operator of this package relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Semantics: timestamps are UTC, a repeated JSON key takes its last value.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Documents are stored and read as a whole, so taking them apart in files only costs time.
    "spark.sql.variant.inferShreddingSchema": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def get_session(app_name: str = "changetide", master: str | None = None, **options: str) -> SparkSession:
    """Create (or reuse) a session; cluster sizing is left to the submitter."""
    builder = SparkSession.builder.appName(app_name).config("spark.ui.enabled", "false")
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_SETTINGS, **options}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Shared folder for checkpoints: the cluster's own setting wins."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if fallback is None:
        raise ValueError("spark.checkpoint.dir is unset and no fallback folder was given")
    return fallback


def work_folder(spark: SparkSession) -> str:
    """A new folder for stored tables and stream checkpoints, in the cluster's shared folder.

    Only a session of one machine may do without that setting; it gets a temporary folder.
    """
    master = spark.sparkContext.master
    alone = master == "local" or master.startswith("local[")
    own = os.path.join(tempfile.gettempdir(), "changetide") if alone else None
    return f"{checkpoint_dir(spark, own)}/{uuid.uuid4().hex}"
