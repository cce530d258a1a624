"""Corpus files, charts and sheets by hand."""

import hashlib
import json

from cantus.operators import sheets as SH
from cantus.sources import corpus as C

SHA = "A" * 64


def test_json_files(spark, tmp_path):
    for name, case in {"a": {"song": "s", "reference": {"key": "C major"}, "hypothesis": {}}, "b": {"song": "s", "reference": {}}, "c": {"song": "s", "reference": 1, "hypothesis": {}}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(case))
    good, bad = C.read_cases(spark, str(tmp_path))
    assert [(r.song, r.reference.key) for r in good.collect()] == [("s", "C major")]
    assert sorted(tuple(r) for r in bad.collect()) == [("b.json", "hypothesis"), ("c.json", "reference")]
    jams = {"annotations": [{"namespace": "beat", "data": []}, {"namespace": "chord", "data": [{"time": 1.0, "duration": 2.0, "value": "Bb:min7"}, {"time": 3.0, "duration": 0.0, "value": "N"}]}]}
    (tmp_path / "x").mkdir()
    (tmp_path / "x/x.jams").write_text(json.dumps(jams))
    good, bad = C.read_annotations(spark, str(tmp_path / "x"))
    assert [tuple(r) for r in good.collect()] == [("x.jams", 0, 1.0, 3.0, "A#m7")] and bad.count() == 0
    assert [tuple(r) for r in C.read_annotations(spark, str(tmp_path / "x"), 1)[1].collect()] == [("x.jams", "index")]


def test_manifest_and_digests(spark, tmp_path):
    data = tmp_path / "data"
    data.mkdir()
    (data / "a.wav").write_bytes(b"abc")
    (data / "e.txt").write_bytes(b"x")
    take = {"name": "t", "split": "comp", "audio": "a.wav", "jams": "a.jams", "audio_sha256": hashlib.sha256(b"abc").hexdigest().upper(), "jams_sha256": SHA, "duration_seconds": 1.5}
    rest = [take | {"name": "u", "split": "x"}, take | {"name": "v", "audio": "/a"}, take | {"name": "w"}, take | {"name": "w"}, take | {"name": "z", "duration_seconds": 0}, take | {"name": "y", "jams_sha256": "1"}]
    (tmp_path / "m.json").write_text(json.dumps({"takes": [take, *rest]}))
    good, bad = C.read_manifest(spark, str(tmp_path / "m.json"))
    assert [r.name for r in good.collect()] == ["t"]
    assert sorted(tuple(r) for r in bad.collect()) == [("u", "split"), ("v", "audio"), ("w", "duplicate"), ("w", "duplicate"), ("y", "jams_sha256"), ("z", "duration_seconds")]
    files = C.read_files(spark, str(data))
    assert sorted(tuple(r) for r in C.verify_files(good, files).collect()) == [("t", "a.jams", "missing"), ("t", "a.wav", "ok")]
    assert sorted((r.path, r.valid, r.warning) for r in C.audio_inventory(files).collect()) == [("a.wav", True, None), ("e.txt", True, "extension")]
    listed = spark.createDataFrame([("x/b.MP3", 0), ("n", 5)], "path string, length bigint")
    assert sorted((r.path, r.valid, r.warning) for r in C.audio_inventory(listed).collect()) == [("n", True, "extension"), ("x/b.MP3", False, None)]
    (tmp_path / "r.jsonl").write_text('{"name": "t"}\n{"na\n')
    assert C.pending(good, spark, str(tmp_path / "r.jsonl")).count() == 0


def test_chart(spark):
    chart = "Title\nC D\n[Verse]\n G |  A    Em\nHello big world\n\n|\nC\n[End]\nlast\n"
    texts = spark.createDataFrame([("a", chart), ("b", None), ("c", "")], "name string, text string")
    lines = [(r.kind, r.content) for r in C.chart_lines(texts).orderBy("line_no").collect()]
    assert lines == [("lyric", None), ("chord", None), ("section", None), ("chord", None), ("lyric", 0), ("lyric", 1), ("chord", None), ("section", None), ("lyric", 2)]
    got = [(r.text, r.column, r.lyric_line, r.word_index) for r in C.chart_chords(texts).orderBy("chord_no").collect()]
    assert got == [("C", 0, None, None), ("D", 2, None, None), ("G", 1, 0, 0), ("A", 6, 0, 1), ("Em", 11, 0, 2), ("C", 0, None, None)]


def test_chordpro(spark):
    songs = spark.createDataFrame([(1, "s.wav", "C major", 120.5), (2, None, None, None)], "song_id int, title string, key_label string, bpm double")
    word = "array<struct<text:string,start:double,end:double>>"
    rows = [(1, 0, "vocal", "a b c", 0.0, [("a", 0.0, 1.0), ("b", 1.0, 2.0), ("c", 9.0, 9.5)]), (1, 1, "instrumental", "", 2.0, None), (1, 2, "vocal", "x\ty\nz", 3.0, [("x", 3.0, None)])]
    lines = spark.createDataFrame(rows, f"song_id int, line_no int, kind string, text string, start double, words {word}")
    events = spark.createDataFrame([(1, 0, 0.0, 1.0, "C"), (1, 1, 1.0, 3.0, "G")], "song_id int, seq int, start double, end double, label string")
    got = {r.song_id: r.sheet for r in SH.chordpro(songs, lines, events).collect()}
    assert got == {1: "{title: s.wav}\n{key: C major}\n{tempo: 120}\n\n[C]a [G]b c\n{soc}\n{eoc}\nx    y z\n", 2: "{title: Unknown title}\n\n"}


def test_a_run_that_was_killed_or_repeated_leaves_one_line_a_take(spark, tmp_path):
    folder, schema = str(tmp_path / "runs"), "name string, score int"
    takes = spark.createDataFrame([(c,) for c in "abcdef"], "name string")
    lines = lambda names, score: spark.createDataFrame([(n, score) for n in names], schema)
    have = lambda: sorted(tuple(x) for x in C.committed(spark, folder, schema).collect())
    left = lambda: sorted(x.name for x in C.unmeasured(takes, C.committed(spark, folder, schema)).collect())
    assert have() == [] and left() == list("abcdef")
    C.append_run(lines("ab", 1), folder, "one")
    C.write_attempt(lines("cd", 2), folder, "two")  # killed before its commit
    assert have() == [("a", 1), ("b", 1)] and left() == list("cdef")
    C.append_run(lines("cdef", 3), folder, "two")
    C.append_run(lines("ab", 4), folder, "one")  # repeated: its new lines replace the old ones
    assert have() == [("a", 4), ("b", 4), ("c", 3), ("d", 3), ("e", 3), ("f", 3)] and left() == []
