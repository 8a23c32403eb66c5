"""Parse and validate event lines.

A line becomes typed columns, or an error text that names the line. Coercion is lax the way
a JSON data validator is: ``"12.5"`` is a number and ``1.0`` an integer, but ``1.5`` is not,
and text fields take only text. Unknown fields are dropped; both the camel-case and the
snake-case name of a field are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkscope import schema
from linkscope.functions.events import is_object, utc_timestamp
from linkscope.sources.batches import BATCH_KEYS, LISTING_NO

EMPTY_BATCH = "Batch did not contain any event lines."
BROKEN_BODY = "Body is not a JSON document."

# Fixed patterns of the accepted texts.
_DATE_TIME = (
    r"^\d{4}-\d{2}-\d{2}([Tt ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?\s*([Zz]|[+-]\d{2}:?\d{2})?)?$"
)
_NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
_INTEGER = r"^[+-]?\d+(\.0*)?$"
_STRIPPED = " \t\n\r\f\x0b"
_BYTE_ORDER_MARK = "﻿"

def _wrapped(line: Column) -> Column:
    return F.try_parse_json(F.concat(F.lit("["), line, F.lit("]")))


def _single_value(line: Column, wrapped: Column) -> Column:
    """The one JSON value of a line, given the line parsed in brackets.

    The parser stops after the first value. Inside brackets, text after it is an error or a
    second element; only a stray ``]`` behind the value could close the bracket early, and then the same line inside an object does not parse.
    """
    single = F.try_variant_get(wrapped, "$[1]", "variant").isNull()
    closed = ~F.contains(line, F.lit("]")) | F.try_parse_json(
        F.concat(F.lit('{"line":'), line, F.lit("}"))
    ).isNotNull()
    return F.when(single & closed, F.try_variant_get(wrapped, "$[0]", "variant"))


def with_document(rows: DataFrame, text: str) -> DataFrame:
    """Replace a text column by ``document``: its JSON value, null if it is not exactly one."""
    wrapped = rows.withColumn("wrapped", _wrapped(F.col(text)))
    return wrapped.withColumn("document", _single_value(F.col(text), F.col("wrapped"))).drop("wrapped", text)


def _text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def _absent(kind: Column) -> Column:
    return kind.isNull() | (kind == "VOID")


def _number(value: Column, kind: Column, pattern: str = _NUMBER) -> Column:
    """A number, a boolean, or a text that reads as a number."""
    text = F.btrim(_text(value), F.lit(_STRIPPED))
    fits = (kind != "STRING") | F.regexp_like(text, F.lit(pattern))
    return F.when(fits, F.try_variant_get(value, "$", "double"))


def _whole(number: Column) -> Column:
    """A number without fraction as an integer; null if it has one or is too large."""
    return F.when(number == F.floor(number), number.try_cast("int"))


def _timestamp(value: Column, kind: Column) -> Column:
    text = F.btrim(_text(value), F.lit(_STRIPPED))
    return F.when((kind == "STRING") & F.regexp_like(text, F.lit(_DATE_TIME)), utc_timestamp(text))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Non-blank lines with a ``document`` variant; null where the line is not JSON."""
    text = F.btrim(F.ltrim(F.col("value"), F.lit(_BYTE_ORDER_MARK)), F.lit(_STRIPPED))
    return (
        lines.withColumn("line", text)
        .filter(F.length("line") > 0)
        .drop("value")
        .transform(with_document, "line")
    )


# Both names of every field, read from the document in one go.
_NAMES = sorted({name for pair in schema.WIRE_FIELDS for name in pair})
_FIELDS_TYPE = f"struct<{', '.join(f'{name}: variant' for name in _NAMES)}>"


def validate_events(parsed: DataFrame) -> DataFrame:
    """Typed event columns and ``error`` for the output of :func:`parse_lines`.

    Each stage only reads columns of the one before, so that no expression is evaluated twice.
    """
    others = [c for c in parsed.columns if c != "document"]
    wire = dict(schema.WIRE_FIELDS)
    invalid = F.col("document").isNull().alias("invalid")

    fields = parsed.select(
        *others, invalid, F.try_variant_get("document", "$", _FIELDS_TYPE).alias("fields")
    )
    found = fields.select(
        *others,
        "invalid",
        *[F.coalesce(f"fields.{wire[c]}", f"fields.{c}").alias(f"f_{c}") for c in wire],
    )
    kinds = found.select(
        "*",
        *[F.schema_of_variant(f"f_{c}").alias(f"k_{c}") for c in wire if c != "metadata"],
        is_object(F.col("f_metadata")).alias("k_metadata"),
    )
    typed = kinds.select(
        *others,
        "invalid",
        *[f"k_{c}" for c in wire],
        *[_typed(c, F.col(f"f_{c}"), F.col(f"k_{c}")).alias(c) for c in wire],
    )
    typed = typed.withColumns({c: _whole(F.col(c)) for c in schema.OPTIONAL_INTEGER})
    broken = F.concat_ws(
        "; ", *[_rule(c, wire[c], F.col(c), F.col(f"k_{c}")) for c in wire]
    ).alias("broken")
    judged = typed.select(*others, *wire, "invalid", broken)

    line_no = F.col("line_no").cast("string")
    error = F.when(F.col("invalid"), F.concat(F.lit("Invalid JSON on line "), line_no)).when(
        F.length("broken") > 0,
        F.concat(F.lit("Event validation failed on line "), line_no, F.lit(": "), F.col("broken")),
    )
    return judged.select(*others, *wire, error.alias("error"))


def _typed(column: str, value: Column, kind: Column) -> Column:
    """The value of a field, null where it breaks the type."""
    if column == "metadata":
        return F.when(kind, F.to_json(value))
    if column == "timestamp_utc":
        return _timestamp(value, kind)
    if column in schema.OPTIONAL_NUMBER:
        return _number(value, kind)
    if column in schema.OPTIONAL_INTEGER:
        return _number(value, kind, _INTEGER)
    return F.when(kind == "STRING", _text(value))


def _rule(column: str, wire: str, typed: Column, kind: Column) -> Column:
    """The message of a broken rule, else null."""

    def broken(condition: Column, message: str) -> Column:
        return F.when(condition, F.lit(f"{wire}: {message}"))

    if column == "metadata":
        return broken(~kind, "an object is required")
    if column == "timestamp_utc":
        return broken(typed.isNull(), "a date-time is required")
    if column == "details":
        return broken(typed.isNull(), "text is required")
    if column == "result":
        unsupported = F.concat(F.lit("Unsupported result: "), typed)
        return broken(F.coalesce(typed, F.lit("")) == "", "text is required").when(
            ~typed.isin(*schema.RESULTS), unsupported
        )
    if column in schema.REQUIRED_TEXT:
        return broken(F.coalesce(typed, F.lit("")) == "", "text is required")
    given = ~_absent(kind) & typed.isNull()
    if column in schema.OPTIONAL_TEXT:
        return broken(given, "text expected")
    return broken(given, "number expected" if column in schema.OPTIONAL_NUMBER else "integer expected")


def gate_batches(checked: DataFrame, batches: DataFrame, keys: tuple[str, ...] = BATCH_KEYS) -> DataFrame:
    """One verdict per batch: a bad line, or no event line, rejects all of it.

    Lines and batches that bear their number in the listing meet by that instead of the keys, and verdicts keep it.
    """
    number = [LISTING_NO] if LISTING_NO in checked.columns and LISTING_NO in batches.columns else []
    by = number or list(keys)
    verdicts = checked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.min_by("error", F.when(F.col("error").isNotNull(), F.col("line_no"))).alias("first_error"),
    )
    joined = batches.select(*keys, *number).join(verdicts, by, "left")
    return joined.select(
        *keys,
        *number,
        F.coalesce("event_count", F.lit(0)).alias("event_count"),
        F.when(F.col("event_count").isNull(), F.lit(EMPTY_BATCH)).otherwise(F.col("first_error")).alias("error"),
    )


def accepted_events(checked: DataFrame, verdicts: DataFrame, keys: tuple[str, ...] = BATCH_KEYS) -> DataFrame:
    """Events of the batches without an error."""
    clean = verdicts.filter(F.col("error").isNull()).select(*keys)
    return checked.join(clean, list(keys), "left_semi").drop("error")


def envelope_events(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Event documents of ``{"events": [...]}`` bodies, numbered from 1.

    Each row of ``bodies`` is one request. A body without an event list yields no row: its
    verdict in :func:`gate_batches` is that of an empty batch.
    """
    others = [c for c in bodies.columns if c != body]
    events = F.try_variant_get("document", "$.events", "array<variant>")
    return (
        with_document(bodies, body)
        .select(*others, events.alias("events"))
        .select(*others, F.posexplode_outer("events").alias("position", "document"))
        .filter(F.col("position").isNotNull())
        .select(*others, (F.col("position") + 1).cast("long").alias("line_no"), "document")
    )


