"""I-22: bringing old memory files to their present form: one file of all projects dealt out to projects, and times that lines lack.

Memories are lines of JSON under ``root``/project=NAME. Only the partitions of projects that change are overwritten. A migration notes that it is
done by a marker, written last; one that died before is run again, and comes to the same end, as lines that are as they should be stay as they are.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery import stored

LINES = "value string, project string"
NO_PROJECT = "_default"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of a folder; none if it isn't there."""
    try:
        return spark.read.schema(schema).option("basePath", path).text(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def lines(spark: SparkSession, root: str) -> DataFrame:
    """(value, project) of all memories."""
    return _read(spark, root, LINES).filter("value <> ''")


def _done(spark: SparkSession, root: str, name: str) -> bool:
    return bool(_read(spark, f"{root}-migrations/{name}", "value string").limit(1).count())


def _overwrite(rows: DataFrame, root: str) -> None:
    """The partitions of the projects in ``rows``, which are written elsewhere first, as they were read from there."""
    kept, path = stored.written(rows.select("value", "project"))
    # a project's lines are dealt to as many files as it needs, no project is one task's
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project").text(root)
    stored.drop(rows.sparkSession, path)


def _mark(spark: SparkSession, root: str, name: str, report: dict) -> dict:
    spark.createDataFrame([(json.dumps(report),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}-migrations/{name}")
    return report


def split_projects(spark: SparkSession, legacy: str, root: str) -> dict:
    """Lines of the one file of all projects (``legacy``), each added to its project unless that has a memory of its id already. Lines that are no JSON objects
    are left out, as they have no project; those without a project go to _default. Of lines with one id in a project, all are added."""
    if _done(spark, root, "split-projects"):
        return {"projects": 0, "added": 0}
    field = lambda c, k: F.get_json_object(c, f"$.{k}")
    old = _read(spark, legacy, "value string").filter(F.startswith(F.trim("value"), F.lit("{")) & F.get_json_object("value", "$").isNotNull())
    name = F.trim(F.coalesce(field("value", "project"), F.lit("")))
    old = old.select("value", F.when(name == "", NO_PROJECT).otherwise(name).alias("project"), field("value", "id").alias("id"))
    have = lines(spark, root)
    new = old.join(have.select("project", field("value", "id").alias("id")).distinct(), ["project", "id"], "left_anti").select("value", "project")
    new, path = stored.written(new)
    touched = new.select("project").distinct()
    report = {"projects": touched.count(), "added": new.count()}
    if report["added"]:
        _overwrite(have.join(touched, "project", "left_semi").select("value", "project").union(new), root)
    stored.drop(spark, path)
    return _mark(spark, root, "split-projects", report)


def _iso(value: object, default: str) -> str:
    try:
        at = datetime.fromisoformat(value.strip().replace("Z", "+00:00"))
    except (AttributeError, ValueError):
        return default
    return at.replace(tzinfo=at.tzinfo or timezone.utc).astimezone(timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")


def _ms(value: object, iso: str) -> int | float:
    number = isinstance(value, int | float) and not isinstance(value, bool) and abs(value) < float("inf")
    return value if number else int(datetime.fromisoformat(iso.replace("Z", "+00:00")).timestamp() * 1000)


def with_times(line: str, now: str) -> str:
    """A line whose created and updated times are there, as text and as milliseconds; other lines come back as they are."""
    try:
        entry = json.loads(line)
    except ValueError:
        return line
    if not isinstance(entry, dict):
        return line
    created = _iso(entry.get("createdAt"), now)
    updated = _iso(entry.get("updatedAt"), created)
    times = {"createdAt": created, "updatedAt": updated, "createdAtMs": _ms(entry.get("createdAtMs"), created), "updatedAtMs": _ms(entry.get("updatedAtMs"), updated)}
    return line if all(entry.get(k) == v for k, v in times.items()) else json.dumps(entry | times, ensure_ascii=False)


def add_times(spark: SparkSession, root: str, now: str) -> dict:
    """Times for lines that lack them or have unreadable ones: ``now`` (ISO) for created, created for updated. Projects without such a line aren't written."""
    if _done(spark, root, "add-times"):
        return {"projects": 0, "lines": 0}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            new = [with_times(x, now) for x in pdf["value"]]
            yield pd.DataFrame({"value": new, "project": pdf["project"], "changed": [a != b for a, b in zip(new, pdf["value"], strict=True)]})

    rows, path = stored.written(lines(spark, root).mapInPandas(run, f"{LINES}, changed boolean"))
    touched = rows.filter("changed").groupBy("project").count()
    report = {"projects": touched.count(), "lines": rows.filter("changed").count()}
    if report["lines"]:
        _overwrite(rows.join(touched.select("project"), "project", "left_semi"), root)
    stored.drop(spark, path)
    return _mark(spark, root, "add-times", report)
