"""Merging windows, words of tokens, and texts with times."""

from pyspark.sql import functions as F

from cantus.operators import seams as W
from cantus.sources import timed_text as T

EVENT = "song_id int, idx int, seq int, start double, end double, label string, source string"


def test_windows_merge_once(spark):
    rows = [
        (1, 0, 0, 0.0, 5.0, "C", "a"), (1, 0, 1, 5.0, 10.0, "G", "a"),
        (1, 1, 0, 8.0, 9.0, "F", "a"), (1, 1, 1, 9.0, 12.0, "G", "a"), (1, 1, 2, 12.0, 20.0, "C", "a"),
        (1, 2, 0, 20.04, 25.0, "C", "a"), (1, 2, 1, 25.0, None, "C", "a"), (2, 0, 0, 1.0, 2.0, "C", None), (2, 1, 0, 2.2, 3.0, "C", None), (2, 2, 0, 3.0, 4.0, "C", None),
    ]
    got = [tuple(r) for r in W.merge_windows(spark.createDataFrame(rows, EVENT)).select("song_id", "start", "end", "label").orderBy("song_id", "seq").collect()]
    assert got == [(1, 0.0, 5.0, "C"), (1, 5.0, 12.0, "G"), (1, 12.0, 25.0, "C"), (1, 25.0, None, "C"), (2, 1.0, 2.0, "C"), (2, 2.2, 4.0, "C")]
    plan = spark.createDataFrame([(1, 0, 0.0), (1, 1, 8.5), (1, 2, 18.0)], "song_id int, idx int, start double")
    assert [r.label for r in W.ignored_range(spark.createDataFrame(rows, EVENT), plan).collect()] == ["F"]


def test_lyrics_of_windows(spark):
    word = "array<struct<text:string,start:double,end:double>>"
    rows = [
        (1, 0, 0, 0.0, 9.0, [("a", 0.0, 4.0), ("b", 9.0, 11.0)]), (1, 1, 0, 0.0, 3.0, [("b", 0.5, None)]), (1, 1, 1, 2.0, 4.0, [("c", 2.0, 3.0), ("d", None, None)]),
        (1, 1, 2, None, None, []), (1, 1, 3, None, None, None),
    ]
    lines = spark.createDataFrame(rows, f"song_id int, idx int, seq int, start double, end double, words {word}")
    plan = spark.createDataFrame([(1, 0, 0.0, 10.0), (1, 1, 9.0, 19.0)], "song_id int, idx int, start double, end double")
    got = [(r.start, [w.text for w in r.words or []]) for r in W.merge_lyrics(lines, plan).orderBy("seq").collect()]
    assert got == [(0.0, ["a", "b"]), (11.0, ["c", "d"]), (None, []), (None, [])]


def test_words_of_tokens(spark):
    rows = [(1, 0, i, t, s) for i, (t, s) in enumerate([("Hell", 0.0), ("o", 0.2), (" ", 0.3), ("▁,", 0.4), ("▁world", 1.0), (" back", 0.5), ("!", None)])]
    got = [(r.text, r.start, r.end) for r in W.words_of_tokens(spark.createDataFrame(rows, "song_id int, idx int, token_no int, token string, ts double")).orderBy("word_no").collect()]
    assert got == [("Hello,", 0.0, 1.0), ("world", 1.0, None), ("back!", 0.5, None)]


def test_roll_up(spark):
    rows = [(1, 1, "b", 0.5, 2.0, ["y", "x"]), (1, 0, "a", 0.5, 1.0, ["x"]), (2, 0, None, 0.1, None, None), (2, 1, "c", 0.2, 1.0, None)]
    got = W.roll_up(spark.createDataFrame(rows, "song_id int, idx int, engine string, confidence double, processing_seconds double, warnings array<string>")).orderBy("song_id").collect()
    assert [tuple(r) for r in got] == [(1, "a", 2, 0.5, 3.0, ["x", "y"]), (2, None, 2, None, None, [])]


LRC = "[ti:Song]\n[00:10.5][00:30]Hi  there\nplain\n[offset:-500]\n[00:20.00]<00:20.1>one <00:20.55> <00:21>two\n[01:00]\n[note] spoken\n\n"
SRT = "1\n00:00:05,000 --> 00:00:07,5\nb\n12\nc\n\n2\n00:00:01.000 --> 00:00:02,000\na\n\n3\n00:00:03,000 --> 00:00:04,000\n\nno times\n"


def test_timed_texts(spark):
    bad = "1\n00:00:05,000 --> 00:00:04,000\nx\n"
    texts = spark.createDataFrame([("x/a.LRC", LRC), ("b.srt", SRT), ("c.srt", bad), ("d.txt", "x"), ("e.lrc", ""), ("f.srt", None), ("g", "x")], "name string, text string")
    lines, rejected = T.parse_timed_text(texts)
    got = [(r.text, r.start, r.end) for r in lines.filter("name = 'x/a.LRC'").orderBy("seq").collect()]
    assert got == [("Hi there", 10.5, 19.5), ("one two", 19.5, 30.0), ("Hi there", 30.0, 59.5), ("", 59.5, None), ("plain", None, None), ("spoken", None, None)]
    words = lines.filter(F.size("words") > 0).collect()
    assert [[tuple(w) for w in r.words] for r in words] == [[("one", 20.1, 21.0), ("two", 21.0, 30.0)]]
    assert [(r.text, r.start, r.end) for r in lines.filter("name = 'b.srt'").orderBy("seq").collect()] == [("a", 1.0, 2.0), ("b c", 5.0, 7.5)]
    assert sorted(tuple(r) for r in rejected.collect()) == [("c.srt", "reversed"), ("d.txt", "suffix"), ("e.lrc", "empty"), ("f.srt", "empty"), ("g", "suffix")]


def test_files(spark, tmp_path):
    (tmp_path / "a.lrc").write_text("﻿[00:01]x\n", encoding="utf-8")
    lines, _ = T.parse_timed_text(T.read_texts(spark, str(tmp_path)))
    assert [(r.text, r.start) for r in lines.collect()] == [("x", 1.0)]
