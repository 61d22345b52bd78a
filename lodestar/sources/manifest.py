"""Manifests as JSON lines: written in order, read strictly."""

from __future__ import annotations

from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestar.functions.digests import of_file
from lodestar.functions.paths import require_outside
from lodestar.schemas import INDEX_MANIFEST, MANIFEST
from lodestar.sources import lines


def write(manifest: DataFrame, path: str, evidence: str | Path | None = None) -> None:
    """Write the rows in the order of ordinals as a folder of JSON lines, part after part; refused inside the evidence.

    Spark's commit protocol makes the folder appear as a whole (``_SUCCESS``).
    """
    if evidence is not None:
        require_outside(evidence, path.removeprefix("file://"))
    manifest.orderBy("ordinal").write.option("ignoreNullFields", "false").json(path)


def faults(spark: SparkSession, path: str, schema: StructType = MANIFEST) -> DataFrame:
    """(file, line, number, problem) of a manifest's lines that aren't of the schema, lack a value, or whose ordinal isn't their place; blank lines only count as lines."""
    entries = lines.out_of_order(lines.parsed(lines.numbered(spark, path), schema), "ordinal")
    return entries.where("problem is not null").select("file", "line", "number", "problem")


def read(spark: SparkSession, path: str, schema: StructType = MANIFEST) -> DataFrame:
    """A manifest (a folder or a file); a line that isn't of the schema, lacks a value or is out of place fails with its number."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    entries = lines.parsed(lines.numbered(spark, path), schema)
    plain = F.col("problem").isNull() & (F.col("row.ordinal") == F.col("number"))  # so it is where no line is blank
    if not entries.agg(F.coalesce(F.bool_and(F.coalesce(plain, F.lit(False))), F.lit(True))).first()[0]:
        bad = faults(spark, path, schema).orderBy("number").limit(1).collect()
        if bad:
            raise ValueError(f"manifest {Path(bad[0].file).name} line {bad[0].line} {bad[0].problem}")
    return rows


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return read(spark, path, INDEX_MANIFEST)


def with_content_hash(manifest: DataFrame) -> DataFrame:
    """manifest with the SHA-256 of each file's bytes, read in pieces where the file lies; an unreadable file fails."""
    @F.pandas_udf("string")
    def digest(paths: pd.Series) -> pd.Series:
        return paths.map(of_file)

    return manifest.withColumn("sha256", digest("source_path"))
