"""A history on disk that survives a crash: tables of files that never change, and snapshots that say which of them count.

A write puts its rows under a new folder and then adds one snapshot, a file of one line with the folders of all tables.  A file
appears as a whole or not at all, so a reader sees all of a write or nothing of it, whatever fails between two steps.  One writer
at a time; readers any number.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Store:
    """Tables by name below a folder, as of its newest snapshot."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def snapshot(self) -> dict:
        """{"version": number, "tables": {table: {batch: folder}}}; version 0 without tables if nothing was written yet."""
        try:
            lines = self.spark.read.option("recursiveFileLookup", True).text(f"{self.folder}/snapshots")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return {"version": 0, "tables": {}}
        last = lines.agg(F.max_by("value", F.get_json_object("value", "$.version").cast("long"))).first()[0]
        return json.loads(last) if last else {"version": 0, "tables": {}}

    def commit(self, now: dict, tables: dict) -> None:
        """Make ``tables`` what counts after ``now``.  What a commit that failed has left is not looked at."""
        version = now["version"] + 1
        line = json.dumps({"version": version, "tables": tables})
        self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(f"{self.folder}/snapshots/{version:012d}-{uuid.uuid4().hex}")

    def append(self, batch: str | None = None, **rows: DataFrame) -> None:
        """Add rows to some tables, all at once; a batch that is added again replaces its own rows."""
        batch = batch or uuid.uuid4().hex
        now, new = self.snapshot(), {}
        for table, df in rows.items():
            new[table] = f"data/{table}/{uuid.uuid4().hex}"
            df.write.parquet(f"{self.folder}/{new[table]}")
        tables = {t: dict(b) for t, b in now["tables"].items()}
        for table, path in new.items():
            tables.setdefault(table, {})[batch] = path
        self.commit(now, tables)

    def read(self, table: str, schema: T.StructType | str | None = None) -> DataFrame:
        """All rows of a table; one without any needs a schema."""
        paths = sorted(self.snapshot()["tables"].get(table, {}).values())
        if not paths:
            if schema is None:
                raise ValueError(f"{table} is empty; name its columns")
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(*(f"{self.folder}/{p}" for p in paths))

    def clear(self, count: str = "sessions", tables: tuple[str, ...] = ("sessions", "anomalies")) -> int:
        """Empty some tables, all at once; how many rows the table ``count`` had."""
        now = self.snapshot()
        deleted = self.read(count).count() if now["tables"].get(count) else 0
        self.commit(now, {t: b for t, b in now["tables"].items() if t not in tables})
        return deleted

    def retain(self, table: str, kept: DataFrame) -> None:
        """Replace a table by some of its rows."""
        now, path = self.snapshot(), f"data/{table}/{uuid.uuid4().hex}"
        kept.write.parquet(f"{self.folder}/{path}")
        self.commit(now, {**now["tables"], table: {"kept": path}})
