"""Named snapshots in one table, with a log of commits that tells which version holds."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, Row, SparkSession, Window
from pyspark.sql import functions as F

_COMMIT = "seq bigint, name string, version string, created_at string, records bigint, deleted boolean"


def snapshot_list(snapshots: DataFrame) -> DataFrame:
    """(name, created_at, records) per snapshot, sorted by name."""
    return (
        snapshots.groupBy("name")
        .agg(F.max("created_at").alias("created_at"), F.count("*").alias("records"))
        .orderBy("name")
    )


class SnapshotStore:
    """Save, load, list and delete snapshots of a log in a catalog table.

    Every save writes a version of its own, a partition of ``table``, and then
    one row of ``<table>_commits``.  The last commit of a name tells which version
    holds, so a reader sees the old snapshot or the new one, whole, and a save
    that fails halfway is never seen.  A replaced version stays until the name is
    saved again, for readers that have begun on it.  Counts stand in the commits,
    so listing reads no snapshot.
    """

    def __init__(self, spark: SparkSession, table: str = "snapshots") -> None:
        self._spark = spark
        self._table = table
        self._log = f"{table}_commits"

    def save(self, df: DataFrame, name: str, created_at: datetime | None = None) -> str:
        """Save under ``name``, replacing an older one once the new one is complete."""
        created = (created_at or datetime.now(timezone.utc)).isoformat()
        version, counted = uuid.uuid4().hex, Observation()
        stamps = {"name": name, "created_at": created, "version": version}
        stamped = df.observe(counted, F.count("*").alias("records")).withColumns({c: F.lit(v) for c, v in stamps.items()})
        stamped.write.mode("append").format("parquet").partitionBy(*stamps).saveAsTable(self._table)
        before = self._commits(name)
        self._commit(name, version, created, counted.get["records"])
        self._drop(before[1:])
        return created

    def load(self, name: str) -> DataFrame:
        """The version that holds when this is called, whatever is saved later."""
        commits = self._commits(name)
        if not commits or commits[0].deleted:
            raise FileNotFoundError(f"snapshot '{name}' not found in {self._table}")
        self._spark.catalog.refreshTable(self._table)
        match = (F.col("name") == name) & (F.col("version") == commits[0].version)
        return self._spark.table(self._table).where(match).drop("name", "created_at", "version")

    def list(self) -> DataFrame:
        """All snapshots with their record counts, empty ones included."""
        last = Window.partitionBy("name").orderBy(F.desc("seq"), F.desc("version"))
        ranked = self._all_commits().withColumn("_rank", F.row_number().over(last))
        held = ranked.where((F.col("_rank") == 1) & ~F.col("deleted"))
        return held.select("name", "created_at", "records").orderBy("name")

    def delete(self, name: str) -> bool:
        """Drop the snapshot; whether it existed."""
        commits = self._commits(name)
        if not commits or commits[0].deleted:
            return False
        self._commit(name, "", "", 0, deleted=True)
        self._drop(commits)
        return True

    def _commit(self, name: str, version: str, created: str, records: int, deleted: bool = False) -> None:
        last = self._all_commits().agg(F.max("seq")).first()[0] or 0
        row = [(last + 1, name, version, created, records, deleted)]
        self._spark.createDataFrame(row, _COMMIT).coalesce(1).write.mode("append").format("parquet").saveAsTable(self._log)

    def _commits(self, name: str) -> list[Row]:
        """Commits of a name, the last one first: one row per save."""
        named = self._all_commits().where(F.col("name") == name)
        return named.orderBy(F.desc("seq"), F.desc("version")).collect()

    def _all_commits(self) -> DataFrame:
        if not self._spark.catalog.tableExists(self._log):
            return self._spark.createDataFrame([], _COMMIT)
        # Another session may have written commits since this one listed the files.
        self._spark.catalog.refreshTable(self._log)
        return self._spark.table(self._log)

    def _drop(self, commits: list[Row]) -> None:
        """Drop the files of versions; an empty one has no partition."""
        specs = []
        for commit in commits:
            if commit.version:
                parts = {"name": commit.name, "created_at": commit.created_at, "version": commit.version}
                values = ", ".join(f"{column} = {_literal(value)}" for column, value in parts.items())
                specs.append(f"PARTITION ({values})")
        if specs:
            self._spark.sql(f"ALTER TABLE {self._table} DROP IF EXISTS {', '.join(specs)}")


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
