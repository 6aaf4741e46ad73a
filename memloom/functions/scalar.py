"""Scalar expressions of scoring, admission, ledgers and readers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def idf(docs: Column, df: Column) -> Column:
    return F.ln(F.lit(1.0) + (docs.cast("double") - df + F.lit(0.5)) / (df.cast("double") + F.lit(0.5)))


def saturation(tf: Column, doc_len: Column, mean_len: Column) -> Column:
    return tf * F.lit(K1 + 1) / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * doc_len / mean_len))


def live(expires_at_ms: Column, now_ms: int | Column) -> Column:
    """Not expired; the deadline itself is past, null never expires."""
    return F.coalesce(expires_at_ms > now_ms, F.lit(True))


def deadline(now_ms: Column, ttl_seconds: Column) -> Column:
    """Null without a TTL or when the sum does not fit."""
    return F.try_add(now_ms, F.try_multiply(ttl_seconds, F.lit(1000).cast("long")))


def valid_id(name: Column) -> Column:
    return F.coalesce(name.rlike("^[A-Za-z0-9_-]{1,64}$"), F.lit(False))


def json_valid(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def json_field(text: Column, *path: str) -> Column:
    """A field of a record's metadata as text; null where the text is no JSON or has no such field."""
    return F.get_json_object(text, "$" + "".join(f"['{p}']" for p in path))


def session_millis(text: Column) -> Column:
    """Epoch milliseconds of dates like '1:56 pm on 8 May, 2023', in UTC."""
    return F.unix_millis(F.to_timestamp(F.regexp_replace(F.upper(text), " ON ", " "), "h:mm a d MMMM, yyyy"))


def yes_no(text: Column) -> Column:
    """The last yes or no of a verdict, thinking blocks left out; null if there is none."""
    open_text = F.regexp_replace(F.lower(text), r"(?s)<think>.*?</think>", " ")
    found = F.regexp_extract_all(open_text, F.lit(r"\b(yes|no)\b"), F.lit(1))
    return F.when(F.size(found) > 0, F.element_at(found, -1) == "yes")


def call_cost(input_tokens: Column, cached: Column, output: Column) -> Column:
    """Dollars of a call; a long input has dearer rates."""
    long = input_tokens > 272_000
    rate = lambda a, b: F.when(long, F.lit(a)).otherwise(F.lit(b))
    return ((input_tokens - cached) * rate(0.25, 0.125) + cached * rate(0.025, 0.0125) + output * rate(0.75, 0.50)) / F.lit(1e6)


def percent_encoded(key: Column) -> Column:
    """Key as one path segment: a blank is %20."""
    return F.replace(F.url_encode(key), F.lit("+"), F.lit("%20"))


def rubric_score(text: Column) -> Column:
    """Score of a judge's answer, JSON that may stand in a code fence: 0, 0.5 or 1; null otherwise."""
    bare = F.regexp_replace(F.trim(text), r"^```(?:json)?\s*|\s*```$", "")
    score = F.get_json_object(bare, "$.score").cast("string").try_cast("double")
    return F.when(score.isin(0.0, 0.5, 1.0), score)


def display_bytes(value: Column) -> Column:
    """JSON or UTF-8 values as text, others in base 64."""
    return F.when(F.is_valid_utf8(value.cast("string")), value.cast("string")).otherwise(F.base64(value))


def content_type(kind: Column) -> Column:
    return F.when(kind == "json", "application/json").when(kind == "utf8", "text/plain; charset=utf-8").otherwise("application/octet-stream")


def natural_key(name: Column) -> Column:
    """Sort key under which numbered names come in numeric order."""
    return F.struct(F.regexp_replace(name, r"\d+", ""), F.regexp_extract(name, r"(\d+)", 1).cast("long"))
