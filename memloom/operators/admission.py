"""Admission of memories and proposals as error columns; a null code admits the row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import json_valid
from ..functions.text import has_control, label, labels, trim_space

MAX_CONTENT_BYTES, MAX_METADATA_BYTES, MAX_TAGS, MAX_MEMORY_KEY_BYTES = 16_384, 8_192, 8, 256


def record_error(key: Column, value: Column, kind: str, max_key: int, max_value: int) -> Column:
    text = value.cast("string")
    bad_value = F.octet_length(value) > max_value
    if kind != "bytes":
        bad_value = bad_value | ~F.is_valid_utf8(text)
    if kind == "json":
        bad_value = bad_value | ~json_valid(text)
    bad_key = key.isNull() | (key == "") | (F.octet_length(key) > max_key) | has_control(key) | key.startswith("__")
    return F.when(F.coalesce(bad_key, F.lit(True)), "invalid_key").when(F.coalesce(bad_value, F.lit(True)), "invalid_value")


def normalised(memories: DataFrame) -> DataFrame:
    """Topic and tags in their normal form, event time defaulting to write time, and `error_code`."""
    out = memories.withColumns({"topic_": label(F.col("topic")), "tags_": labels(F.coalesce("tags", F.array().cast("array<string>")), MAX_TAGS)})
    error = (
        F.when(F.col("key").isNull() | (F.octet_length("key") > MAX_MEMORY_KEY_BYTES), "invalid_key")
        .when(F.coalesce(F.octet_length("content"), F.lit(0)).between(1, MAX_CONTENT_BYTES) == F.lit(False), "invalid_content")
        .when(F.col("topic_").isNull(), "invalid_topic")
        .when(F.col("tags_").isNull(), "invalid_tags")
        .when(F.octet_length("metadata") > MAX_METADATA_BYTES, "invalid_metadata")
    )
    return (
        out.withColumn("error_code", error)
        .withColumns({"topic": F.col("topic_"), "tags": F.col("tags_"), "occurred_at_ms": F.coalesce("occurred_at_ms", "written_at_ms")})
        .drop("topic_", "tags_")
    )


def index_entries(memories: DataFrame) -> DataFrame:
    """Time, topic and tag entries of each memory."""
    entries = F.concat(
        F.array(F.struct(F.lit("time").alias("kind"), F.lit("").alias("label")), F.struct(F.lit("topic").alias("kind"), F.col("topic").alias("label"))),
        F.transform("tags", lambda t: F.struct(F.lit("tag").alias("kind"), t.alias("label"))),
    )
    return memories.select("namespace", F.explode(entries).alias("e"), "occurred_at_ms", "key").select("namespace", "e.kind", "e.label", "occurred_at_ms", "key")


#: Bytes of a proposal's texts at most, kinds, operations, and its columns.
PROPOSAL_BYTES = {"entity": 128, "attribute": 128, "value": 1024, "source_id": 256, "source_text": 512}
KINDS = ("fact", "preference", "decision", "event")
OPERATIONS = ("assert", "correct")
PROPOSAL_COLUMNS = (
    "scope", "entity", "attribute", "seq", "operation", "value", "kind", "source_id", "source_text", "source_role", "occurred_at_ms", "valid_until_ms", "expected_revision",
)


def proposal_error(p: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Adds `error_code` to proposals (flat columns, and those named `extra`); other columns are refused."""
    if unknown := set(p.columns) - {*PROPOSAL_COLUMNS, *extra}:
        raise ValueError(f"unknown fields: {sorted(unknown)}")

    def any_of(test, *columns: str) -> Column:
        return reduce(lambda a, b: a | b, (F.coalesce(test(c), F.lit(False)) for c in columns))

    text = F.coalesce  # a null field is an empty one
    blank = any_of(lambda c: trim_space(text(c, F.lit(""))) == "", *PROPOSAL_BYTES)
    long = any_of(lambda c: F.octet_length(c) > PROPOSAL_BYTES[c], *PROPOSAL_BYTES)
    control = any_of(lambda c: trim_space(F.col(c)).rlike(r"\p{C}"), "entity", "attribute")
    correct = F.col("operation") == "correct"
    error = (
        F.when(blank | F.col("occurred_at_ms").isNull(), "missing_field")
        .when(long, "over_limit")
        .when(control, "control_character")
        .when(~text(F.col("operation").isin(*OPERATIONS), F.lit(False)), "invalid_operation")
        .when(~text(F.col("kind").isin(*KINDS), F.lit(False)), "invalid_kind")
        .when(text(F.col("source_role"), F.lit("")) != "user", "invalid_role")
        .when((F.col("occurred_at_ms") < 0) | (F.col("valid_until_ms") <= F.col("occurred_at_ms")), "invalid_expiry")
        .when(correct & text(F.col("expected_revision") < 1, F.lit(True)), "missing_revision")
        .when(~correct & F.col("expected_revision").isNotNull(), "unexpected_revision")
    )
    return p.withColumn("error_code", error)


def quoted(turn_text: Column, quote: Column) -> Column:
    """The quote stands in the turn, word for word."""
    return F.coalesce(F.contains(turn_text, quote) & (quote != ""), F.lit(False))
