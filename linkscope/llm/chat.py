r"""Chat formatting with typed content parts, and reading the format back.

A turn is written as ``<|im_start|>role``, a line feed, its content, ``<|im_end|>`` and a line feed.
Content is a list of typed parts: text is escaped, every other part becomes a placeholder such
as ``<|image|>`` whose reference and expanded token count are kept beside the text. Escaping
doubles ``\`` and writes ``<|`` as ``<\|``, so that no text can form a control string, and is
undone by dropping the backslash before any character.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
START, END = "<|im_start|>", "<|im_end|>"
PLACEHOLDERS = ("image", "audio", "document")

PATCH_PIXELS = 14
AUDIO_TOKENS_PER_SECOND = 25
TOKENS_PER_PAGE = 256

_TURN = re.compile(r"<\|im_start\|>((?:[^\\\n]|\\.)*)\n(.*?)<\|im_end\|>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_PLACEHOLDER = re.compile(r"<\|(?:image|audio|document|attachment)\|>")


def escape(text: Column) -> Column:
    """Text that holds no control string; null becomes empty."""
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.replace(doubled, F.lit("<|"), F.lit("<\\|"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def text_part(text: Column) -> Column:
    """A content list of one text part, of the type that lists of any parts have."""
    nothing = [F.lit(None)] * 5
    return F.array(F.struct(F.lit("text"), text, *nothing)).cast(PARTS)


def _placeholder(part: Column) -> Column:
    kind = F.when(part["kind"].isin(*PLACEHOLDERS), part["kind"]).otherwise(F.lit("attachment"))
    return F.concat(F.lit("<|"), kind, F.lit("|>"))


def _part_tokens(part: Column) -> Column:
    """Tokens that a placeholder stands for once the attachment is encoded; unknown sizes count 0."""
    patches = F.ceil(part["width"] / PATCH_PIXELS) * F.ceil(part["height"] / PATCH_PIXELS)
    return F.coalesce(
        F.when(part["kind"] == "image", patches)
        .when(part["kind"] == "audio", F.ceil(part["seconds"] * AUDIO_TOKENS_PER_SECOND))
        .when(part["kind"] == "document", part["pages"].cast("long") * TOKENS_PER_PAGE),
        F.lit(0),
    ).cast("long")


def visit_parts(parts: Column, typed: bool = True) -> tuple[Column, Column, Column]:
    """Flattened content, its attachments in order, and the tokens they expand to.

    The visitor goes through the parts once per result, inside the row. Null parts are skipped, a
    part of unknown kind becomes ``<|attachment|>``, null content is empty. ``typed=False`` is
    for content known to be text only, which has no attachment fields.
    """
    present = F.filter(F.coalesce(parts, F.array()), lambda part: part.isNotNull())
    is_text = lambda part: F.coalesce(part["kind"], F.lit("text")) == "text"
    flat = F.array_join(
        F.transform(present, lambda part: F.when(is_text(part), escape(part["text"])).otherwise(_placeholder(part))),
        "",
    )
    if not typed:
        none = F.array().cast("array<struct<ordinal:int,kind:string,ref:string,tokens:bigint>>")
        return flat, none, F.lit(0).cast("long")
    attached = F.transform(
        F.filter(present, lambda part: ~is_text(part)),
        lambda part, n: F.struct(
            n.alias("ordinal"), part["kind"].alias("kind"), part["ref"].alias("ref"), _part_tokens(part).alias("tokens")
        ),
    )
    return flat, attached, F.aggregate(attached, F.lit(0).cast("long"), lambda total, one: total + one["tokens"])


def format_turns(turns: DataFrame, parts: Column, typed: bool = True) -> DataFrame:
    """One formatted segment per turn: conv_id, turn, segment, attachments, attachment_tokens.

    A conversation is the concatenation of its segments in order of turn; equal turn numbers are
    ordered by their segment, a null turn comes first. A null role is an empty one, rows with a null
    conv_id form one conversation, repeated rows are repeated turns. Segments stay rows, so a
    conversation may be of any length.
    """
    flat, attachments, tokens = visit_parts(parts, typed)
    # A line feed ends the role, so one inside a role is escaped as well.
    role = F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\\n"))
    return turns.select(
        "conv_id",
        "turn",
        F.concat(F.lit(START), role, F.lit("\n"), flat, F.lit(END + "\n")).alias("segment"),
        attachments.alias("attachments"),
        tokens.alias("attachment_tokens"),
    )


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn in a formatted text; placeholders stay in the text as they are."""
    turns, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if found is None:
            raise ValueError(f"no turn at character {at}")
        turns.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return turns


def loss_spans(formatted: str, role: str = "assistant") -> list[tuple[int, int]]:
    """Character ranges that take part in the loss: the escaped content of the role's turns."""
    return [found.span(2) for found in _TURN.finditer(formatted) if unescape(found[1]) == role]


def placeholders(formatted: str) -> list[str]:
    """Placeholders in order; escaped text cannot add any."""
    return _PLACEHOLDER.findall(formatted)


SUMMARY = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, "
    "n_attachments bigint, attachment_tokens bigint"
)


class _Summary:
    """Running digests of one conversation."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id = conv_id
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = self.n_attachments = self.attachment_tokens = 0

    def add(self, segment: str, attachments: int, tokens: int) -> None:
        self.n_attachments += attachments
        self.attachment_tokens += tokens
        for role, text in read_turns(segment):
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode())
        for first, last in loss_spans(segment):
            text = unescape(segment[first:last])
            self.loss_chars += len(text)
            self.loss.update(text.encode())
        self.formatted_chars += len(segment)

    def row(self) -> dict:
        return {
            "conv_id": self.conv_id,
            "n_turns": self.n_turns,
            "turns_sha256": self.turns.hexdigest(),
            "loss_chars": self.loss_chars,
            "loss_sha256": self.loss.hexdigest(),
            "formatted_chars": self.formatted_chars,
            "n_attachments": self.n_attachments,
            "attachment_tokens": self.attachment_tokens,
        }


def summarize(segments: DataFrame) -> DataFrame:
    """Digests of every conversation, read back from its formatted segments, and its attachments and their tokens.

    Segments of a conversation pass by in order and only running digests are kept, so a task's
    memory does not depend on the length of a conversation. A digest is sequential by nature: one
    task reads one conversation.
    """
    schema = pa.schema(
        [
            ("conv_id", pa.int64()),
            ("n_turns", pa.int64()),
            ("turns_sha256", pa.string()),
            ("loss_chars", pa.int64()),
            ("loss_sha256", pa.string()),
            ("formatted_chars", pa.int64()),
            ("n_attachments", pa.int64()),
            ("attachment_tokens", pa.int64()),
        ]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = None
        for batch in batches:
            done = []
            columns = (batch[name].to_pylist() for name in ("conv_id", "segment", "n_attachments", "attachment_tokens"))
            for conv_id, segment, attachments, tokens in zip(*columns, strict=True):
                if current is None or current.conv_id != conv_id:
                    if current is not None:
                        done.append(current.row())
                    current = _Summary(conv_id)
                current.add(segment, attachments, tokens)
            yield pa.RecordBatch.from_pylist(done, schema)
        if current is not None:
            yield pa.RecordBatch.from_pylist([current.row()], schema)

    ordered = (
        segments.select(
            "conv_id",
            "turn",
            "segment",
            F.size("attachments").cast("long").alias("n_attachments"),
            "attachment_tokens",
        )
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "segment")
    )
    return ordered.mapInArrow(read, SUMMARY)
