"""File layouts for exchange with collectors and other tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkscope import schema

# Fixed columns of the CSV mirror, in order.
CSV_COLUMNS = tuple(schema.WIRE_FIELDS[:13])

# A column of JSON texts is written through the CSV writer, which can name the file
# extension. Its separator and quote are characters that JSON text never contains.
_LINE_OPTIONS = {
    "extension": "jsonl",
    "sep": "\u0001",
    "quote": "\u0002",
    "escapeQuotes": "false",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def wire_time(timestamp: str | Column = "timestamp_utc") -> Column:
    """Round-trip UTC text with seven fraction digits."""
    column = F.col(timestamp) if isinstance(timestamp, str) else timestamp
    text = F.date_format(column.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(text, F.lit("0Z"))


def event_json() -> Column:
    """One compact JSON object per event: wire order, explicit nulls."""
    fields = []
    for column, wire in schema.WIRE_FIELDS:
        value = F.col(column)
        if column == "timestamp_utc":
            value = wire_time()
        elif column == "metadata":
            value = F.coalesce(F.try_parse_json(column), F.parse_json(F.lit("{}")))
        fields.append(value.alias(wire))
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def write_jsonl(events: DataFrame, path: str, by_site: bool = False, mode: str = "errorifexists") -> None:
    """Write ``*.jsonl`` batch files, with ``by_site`` one folder per site."""
    columns = ["site_id"] if by_site else []
    lines = events.select(*columns, event_json().alias("line"))
    write_lines(lines, path, columns, mode)


def write_lines(
    lines: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists"
) -> None:
    """Write a frame of JSON texts as ``*.jsonl`` files."""
    writer = lines.write.mode(mode).options(**_LINE_OPTIONS)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.csv(path)


def csv_rows(events: DataFrame) -> DataFrame:
    """The thirteen mirror columns as text, under their wire names."""
    return events.select(
        *[
            (wire_time() if column == "timestamp_utc" else F.col(column).cast("string")).alias(wire)
            for column, wire in CSV_COLUMNS
        ]
    )


def write_csv_mirror(events: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Quoted CSV with a header; quotes inside a field are doubled. Nulls are empty."""
    csv_rows(events).write.mode(mode).options(
        header="true", quoteAll="true", escape='"', nullValue="", emptyValue=""
    ).csv(path)
