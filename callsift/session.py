"""Session defaults.  Operators work on any session; these are recommendations."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Recording the Python line of every column expression takes longer than planning.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # Seen ids of a watched log outgrow memory; see streaming/watch.py.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def build_session(app_name: str = "callsift", master: str | None = None, **conf) -> SparkSession:
    """Get or create a session with :data:`DEFAULTS`; ``conf`` entries override them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
