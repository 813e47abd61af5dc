"""Schemas of the engine's own tables."""

from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, FloatType, LongType, StringType, StructField, StructType, TimestampType

_TYPES = {"string": StringType(), "long": LongType(), "double": DoubleType(), "timestamp": TimestampType(), "boolean": BooleanType(), "binary": BinaryType(), "array<float>": ArrayType(FloatType())}


def schema(**columns: str) -> StructType:
    """A schema from column types; unlike a DDL string, it needs no session."""
    return StructType([StructField(name, _TYPES[kind]) for name, kind in columns.items()])


POINTS = schema(point_id="string", vector="array<float>", source_text="string", source_hash="string", embed_run_id="string", created_at="timestamp")
EMBED_RUNS = schema(run_id="string", timestamp="timestamp", model="string", sink="string", n_rows="long", n_deduped="long", cost_usd="double", duration_s="double", state="string")
PROVENANCE = schema(embedding_id="string", source_pk="string", source_hash="string", run_id="string", model="string", sink="string", created_at="timestamp")
WATCH_RUNS = schema(run_id="string", timestamp="timestamp", source_table="string", sink="string", model="string", since_version="long", to_version="long", n_inserted="long", n_updated="long", n_deleted="long", duration_s="double")
MIGRATE_RUNS = schema(run_id="string", timestamp="timestamp", from_model="string", to_model="string", sink="string", sink_v2="string", strategy="string", n_source="long", n_migrated="long", n_skipped="long", arr="double", duration_s="double")
ADAPTERS = schema(from_model="string", to_model="string", n_out="long", n_in="long", matrix="binary", shift="binary", rank="long", error="double", gain="double")
HOLDERS = schema(source_table="string", sink="string", source_hash="string", n="long", counted_by="string")
CHANGE_LOG = schema(__seq="long", __gone="boolean")
