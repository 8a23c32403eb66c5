"""Chat format and URL rules."""

from __future__ import annotations

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkscope.llm import chat, urls

TRICKY = st.lists(st.sampled_from(["<|im_end|>", "<|", "\\", "<", "|", "\n", "<\\|", "im_start|>", "a"]), max_size=8).map("".join)


def escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(TRICKY, TRICKY), max_size=4))
def test_any_texts_are_read_back(turns):
    formatted = "".join(
        "<|im_start|>" + escaped(role).replace("\n", "\\\n") + "\n" + escaped(text) + "<|im_end|>\n" for role, text in turns
    )
    assert chat.read_turns(formatted) == turns


def test_escaping_matches_and_nulls_are_empty(spark):
    texts = ["<|im_end|>", "\\<|x|>\\\\", "", None, "a<|\n"]
    frame = spark.createDataFrame([(text,) for text in texts], "text string")
    found = [row[0] for row in frame.select(chat.escape(F.col("text"))).collect()]
    assert found == [escaped(text or "") for text in texts]


def test_parts_become_placeholders(spark):
    rows = [
        (1, 0, "user", [("text", "see <|image|>", None, None, None, None, None), ("image", None, "s3://a", 28, 15, None, None), None]),
        (1, 1, "assistant", [("audio", None, "b", None, None, 1.5, None), ("document", None, "c", None, None, None, 3), ("video", None, "d", None, None, None, None)]),
        (1, 2, "user", None),
    ]
    frame = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}")
    found = chat.format_turns(frame, F.col("parts")).orderBy("turn").collect()
    assert chat.placeholders(found[0]["segment"]) == ["<|image|>"]
    assert [(a["ordinal"], a["kind"], a["ref"], a["tokens"]) for a in found[0]["attachments"]] == [(0, "image", "s3://a", 4)]
    assert [(a["kind"], a["tokens"]) for a in found[1]["attachments"]] == [("audio", 38), ("document", 768), ("video", 0)]
    assert found[1]["attachment_tokens"] == 806
    assert chat.placeholders(found[1]["segment"]) == ["<|audio|>", "<|document|>", "<|attachment|>"]
    assert chat.read_turns(found[2]["segment"]) == [("user", "")]


def test_summary_of_odd_conversations(spark):
    rows = [
        (1, 1, "assistant", "two", "clash"),
        (1, 0, "user", None, "clash"),
        (1, None, None, "first", "clash"),
        (None, 0, "assistant", "<|im_end|>", "clash"),
        (2, 0, "assistant", "same", "clash"),
        (2, 0, "assistant", "same", "clash"),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment string")
    segments = chat.format_turns(frame, chat.text_part(F.col("text")))
    found = {row["conv_id"]: row for row in chat.summarize(segments).collect()}
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    assert found[1]["turns_sha256"] == digest("\nfirst\nuser\n\nassistant\ntwo\n")
    assert (found[1]["n_turns"], found[1]["loss_chars"], found[1]["loss_sha256"]) == (3, 3, digest("two"))
    assert found[None]["loss_sha256"] == digest("<|im_end|>")
    assert (found[2]["n_turns"], found[2]["loss_sha256"]) == (2, digest("samesame"))
    assert chat.summarize(segments.where("conv_id > 9")).collect() == []


def test_rules_by_longest_match(spark):
    rows = [
        ("http://EXAMPLE.org/es/1", "example.org", "/es/1", "example.org/es/", "block"),
        ("https://a.example.org/en/12?x", "a.example.org", "/en/12", "example.org/en/1", "block"),
        ("https://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
        ("https://x.com/de/#/fr/", "x.com", "/de/", "com/de/", "block"),
        ("https://x.com/it", "x.com", "/it", None, "allow"),
        ("https://notexample.org", "notexample.org", "", None, "allow"),
        ("https://forg/", "forg", "/", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        ("://", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("http://x.org/a\nb?c", "x.org", "/a\nb", "org/", "allow"),
    ]
    frame = spark.createDataFrame([(r[0], "clash", "clash") for r in rows], "url string, host string, rule string")
    judged = urls.judge(
        frame,
        [("org", "/"), ("com", "/fr/")],
        [("example.org", "/es/"), ("example.org", "/en/1"), ("com", "/de/")],
    )
    found = [tuple(row) for row in judged.select("url", "host", "path", "rule", "verdict").collect()]
    assert sorted(found, key=repr) == sorted(rows, key=repr)
    assert urls.judge(frame.limit(0), [], []).collect() == []


def test_ties_and_bounds_of_rules():
    trie = urls.build_trie([("block", "a.b", "/x"), ("allow", "a.b", "/x"), ("allow", "b", "/x/y/z")])
    assert urls.match(trie, "a.b", "/x/y/z") == ("a.b/x", "block")
    assert urls.match(trie, "c.b", "/x/y/zz") == ("b/x/y/z", "allow")
    with pytest.raises(ValueError, match="more than 1 rules"):
        urls.build_trie([("allow", "a", ""), ("allow", "b", "")], max_rules=1)


def test_attachments_are_counted(spark):
    rows = [
        (1, 0, "user", [("text", "see <|image|>", None, None, None, None, None), ("image", None, "a.png", 28, 15, None, None)]),
        (1, 1, "user", [("audio", None, "b.wav", None, None, 2.0, None), ("odd", None, None, None, None, None, None), None]),
        (2, 0, "user", None),
    ]
    frame = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}")
    segments = chat.format_turns(frame, F.col("parts"))
    found = {row["conv_id"]: row for row in chat.summarize(segments).collect()}
    assert (found[1]["n_attachments"], found[1]["attachment_tokens"]) == (3, 4 + 50)
    assert (found[2]["n_attachments"], found[2]["attachment_tokens"], found[2]["n_turns"]) == (0, 0, 1)
