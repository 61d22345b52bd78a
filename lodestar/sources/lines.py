"""Lines of text files with their numbers, whatever the splits they are read in.

A scan knows in which byte range of which file a row lies, and meets a range's
lines in order.  A line's number is its place in its range and the lines of the ranges before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lodestar.session import few, materialized

_CORRUPT = "__corrupt"


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(file, begin, line, number, value): line counts from 1 in each file, number from 0 over all files by name; begin is the byte range's."""
    meta = F.col("_metadata")
    read = spark.read.text(path).select("value", meta["file_path"].alias("file"), meta["file_block_start"].alias("begin"), F.monotonically_increasing_id().alias("at"))
    ranges = materialized(read.groupBy("file", "begin").agg(F.min("at").alias("first"), F.count("*").alias("n")))
    before = lambda *by: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("file", "begin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = ranges.select("file", "begin", "first", before("file").alias("in_file"), before().alias("in_all"))  # a row for each range of many megabytes
    place = F.col("at") - F.col("first")
    return read.join(few(offsets), ["file", "begin"]).select("file", "begin", (place + F.col("in_file") + 1).alias("line"), (place + F.col("in_all")).alias("number"), "value")


def parsed(lines: DataFrame, schema: StructType) -> DataFrame:
    """lines with ``row`` (a struct of the schema) and ``problem``: what is wrong with a line, null if nothing; blank lines are left out."""
    wide = StructType([*schema.fields, StructField(_CORRUPT, StringType())])
    row = F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    lacking = F.filter(F.array(*[F.when(F.col("row")[f.name].isNull(), F.lit(f.name)) for f in schema]), lambda x: x.isNotNull())
    problem = F.when(F.col("row").isNull() | F.col("row")[_CORRUPT].isNotNull(), "isn't a JSON object of the columns and types asked for").when(F.size(lacking) > 0, F.concat(F.lit("lacks "), F.array_join(lacking, ", ")))
    return lines.where(F.trim(F.translate("value", "\t\r\n\x0b\x0c", "     ")) != "").withColumn("row", row).withColumn("problem", problem)


def out_of_order(entries: DataFrame, ordinal: str) -> DataFrame:
    """parsed() lines with ``expected``, their place among all that aren't blank, and a problem where the row's ordinal is another.

    Lines are counted within their byte range and over the ranges before it, so that no task holds more than a range.
    """
    within = Window.partitionBy("file", "begin").orderBy("line")
    counts = materialized(entries.groupBy("file", "begin").agg(F.count("*").alias("n")))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "begin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = entries.withColumn("place", F.row_number().over(within) - 1).join(few(counts.select("file", "begin", before.alias("before"))), ["file", "begin"]).withColumn("expected", (F.col("place") + F.col("before")).cast("long"))
    own = F.col("row")[ordinal]
    gap = F.when(~own.eqNullSafe(F.col("expected")), F.concat(F.lit(f"has {ordinal} "), own.cast("string"), F.lit(" where a contiguous manifest has "), F.col("expected").cast("string")))
    return placed.withColumn("problem", F.coalesce("problem", gap)).drop("place", "before")
