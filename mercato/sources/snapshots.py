"""Tables that are replaced as a whole: a reader sees the old state or the new one, never a mixture.

A state is a folder of its own; a manifest entry, written last, makes it the current one. A load that dies
before leaves a folder that no entry names, and the old state stays readable. Entries are numbered; of two
entries with one number (two writers at once) the greater folder name counts, for all readers alike.

    path/state-<id>/...       one state, whatever lies in it
    path/manifest/*.json      {"number": 3, "state": "state-<id>"}
"""

from __future__ import annotations

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_state(path: str) -> str:
    """A folder name for a new state of the table at ``path``."""
    return f"{path.rstrip('/')}/state-{uuid.uuid4().hex}"


def states(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """The table's manifest entries (number, folder name), newest first; none for a new table."""
    try:
        rows = spark.read.schema("number long, state string").json(f"{path.rstrip('/')}/manifest").distinct()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return []
        raise
    # one small row a load
    return [(r["number"], r["state"]) for r in rows.orderBy(F.desc("number"), F.desc("state")).collect()]


def switch(spark: SparkSession, path: str, folder: str) -> int:
    """Make ``folder`` (from :func:`new_state`, completely written) the current state; returns its number."""
    name = folder.rstrip("/").rsplit("/", 1)[-1]
    if not re.fullmatch(r"state-[0-9a-f]{32}", name):
        raise ValueError(f"not a state: {folder!r}")
    manifest = f"{path.rstrip('/')}/manifest"
    spark.createDataFrame([], "number long, state string").write.mode("ignore").json(manifest)  # a folder to read from
    number = max((n for n, _ in states(spark, path)), default=0) + 1
    spark.createDataFrame([(number, name)], "number long, state string").coalesce(1).write.mode("append").json(manifest)
    return number


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the current state, or None for a new table."""
    found = states(spark, path)
    return f"{path.rstrip('/')}/{found[0][1]}" if found else None


def read(spark: SparkSession, path: str) -> DataFrame:
    """The current state, written as Parquet."""
    folder = current(spark, path)
    if folder is None:
        raise ValueError(f"no state at {path!r}")
    return spark.read.parquet(folder)
