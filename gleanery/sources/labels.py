"""H-23: versioned sets of labelled samples. A version is never changed once it is there, and the same samples make no second one.

The samples of a version are written first, and its line in ``manifests`` last: a version without its line is not there, and is written over by the next
attempt. Readers take the newest version that is there.
"""

from __future__ import annotations

import json
import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLES = "id string, input string, output string, intent string, risk string"
VERSION = r"\d+\.\d+\.\d+"


def tag(x: Column) -> Column:
    """Lower case, dashes between what is left of other characters; unknown if nothing is."""
    t = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(x, F.lit("")))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(t == "", "unknown").otherwise(t)


def prepared(samples: DataFrame) -> DataFrame:
    """(id, input, output, intent, risk) -> SAMPLES: trimmed, and tags normalised. A sample without an id is named by its texts; one without input or output stops the run."""
    text = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.trim(c)).otherwise(F.raise_error(F.lit(f"samples need an {c}")).cast("string"))
    own = F.concat(F.lit("sample-"), F.substring(F.sha2(F.concat_ws("\x1f", "input", "output"), 256), 1, 12))
    name = F.when(F.trim(F.coalesce("id", F.lit(""))) != "", F.trim("id")).otherwise(own)
    return samples.select(name.alias("id"), text("input").alias("input"), text("output").alias("output"), tag(F.col("intent")).alias("intent"), tag(F.col("risk")).alias("risk"))


def digest(samples: DataFrame) -> tuple[str, int]:
    """A hash of the samples, whatever their order, and their number: the sums of four parts of each row's sha256 are hashed, so that nothing is sorted or collected."""
    row = F.sha2(F.to_json(F.struct("id", "input", "output", "intent", "risk")), 256)
    parts = [F.sum(F.conv(F.substr(row, F.lit(1 + 15 * k), F.lit(15)), 16, 10).cast("decimal(38,0)")).cast("string").alias(f"p{k}") for k in range(4)]
    got = samples.agg(F.count("*").alias("n"), *parts).select("n", F.sha2(F.concat_ws(",", F.col("n").cast("string"), "p0", "p1", "p2", "p3"), 256).alias("sha")).first()
    return got.sha, got.n


def manifests(spark: SparkSession, target: str, name: str) -> list[dict]:
    """Manifests of the versions that are there, oldest first."""
    try:
        rows = spark.read.schema("line string").option("recursiveFileLookup", True).text(f"{target}/{name}/manifests").collect()  # a line per version
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return []
    return sorted((json.loads(r.line) for r in rows), key=lambda m: [int(x) for x in m["version"].split(".")])


def _publish(spark: SparkSession, manifest: dict, target: str) -> None:
    line = spark.createDataFrame([(json.dumps(manifest),)], "line string").coalesce(1)
    line.write.mode("overwrite").text(f"{target}/{manifest['dataset']}/manifests/{manifest['version']}")


def write(spark: SparkSession, samples: DataFrame, target: str, name: str, source: str = "", version: str | None = None) -> dict:
    """The manifest of the version that holds ``samples``: that of the newest one if it holds just them (then nothing is written), else of a new one, which has the next
    patch number or the ``version`` that is asked for. A version that is there with other samples is an error; so is an empty set."""
    if version is not None and not re.fullmatch(VERSION, version):
        raise ValueError(f"not a version: {version}")
    rows = prepared(samples)
    sha, n = digest(rows)
    if not n:
        raise ValueError("no samples")
    there = manifests(spark, target, name)
    same = [m for m in there if m["sha256"] == sha and version in (None, m["version"])]
    if same and (version is not None or same[-1] is there[-1]):
        return same[-1]
    if version in {m["version"] for m in there}:
        raise ValueError(f"version {version} is there with other samples")
    if version is None:
        major, minor, patch = there[-1]["version"].split(".") if there else ("1", "0", "-1")
        version = f"{major}.{minor}.{int(patch) + 1}"
    manifest = {"schemaVersion": "1.0", "dataset": name, "version": version, "source": source, "sha256": sha, "sampleCount": n}
    rows.write.mode("overwrite").json(f"{target}/{name}/versions/{version}")
    _publish(spark, manifest, target)
    return manifest


def read(spark: SparkSession, target: str, name: str, version: str | None = None) -> DataFrame:
    """The samples of a version, of the newest one without ``version``."""
    there = [m["version"] for m in manifests(spark, target, name)]
    if not there or (version is not None and version not in there):
        raise ValueError(f"no version {version or ''} of {name}")
    return spark.read.schema(SAMPLES).json(f"{target}/{name}/versions/{version or there[-1]}")
