"""Schemas of the records that the operators exchange."""

from pyspark.sql.types import ArrayType, ByteType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType

_TYPES = {"string": StringType(), "long": LongType(), "int": IntegerType(), "byte": ByteType(), "double": DoubleType(), "floats": ArrayType(FloatType())}


def _schema(**fields: str) -> StructType:
    """A schema that needs no session to be made."""
    return StructType([StructField(name, _TYPES[kind]) for name, kind in fields.items()])


MANIFEST = _schema(ordinal="long", relative_path="string", source_path="string")
INDEX_MANIFEST = _schema(ordinal="long", relative_path="string", source_path="string", size="long", mtime_ns="long", sha256="string")
DISCOVERY_ERROR = _schema(path="string", error_type="string", message="string")
ERROR = _schema(ordinal="long", relative_path="string", source_path="string", error_type="string", message="string", phase="string", model_id="string")
QUERIES = _schema(query_id="string", position="int", original_query="string", model_query="string")
SCORES = _schema(model_id="string", query_id="string", file_id="long", score="double")
RANKED = _schema(model_id="string", query_id="string", file_id="long", score="double", rank="int")
INDEX_ROWS = _schema(model_id="string", ordinal="long", state="byte", embedding="floats")
COMMIT = _schema(sequence="int", model_id="string", start="long", end="long", valid_count="long", error_count="long", rows_sha256="string", committed_at="string")
#: A line of an index's journal: the commit, and the seal of its file.
JOURNAL = StructType([*COMMIT.fields, *_schema(file_size="long", file_sha256="string", mtime_ns="long", ctime_ns="long", inode="long").fields])
PASSES = _schema(model_id="string", ordinal="long", status="string")

#: States of an index row (fixed values).
PENDING, VALID, DECODE_ERROR = 0, 1, 2
#: The two models in the order that ties and labels go by, with their labels (fixed values).
MODELS = {"siglip2": "SigLIP2", "clip": "CLIP"}
