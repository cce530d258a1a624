"""Jobs over a corpus: the operators of the library joined end to end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantus.functions import scalars as S
from cantus.operators import decoding as DE
from cantus.operators import frames as FR
from cantus.operators import placement as PL
from cantus.operators import scoring as SC
from cantus.operators import seams as SE
from cantus.operators import timeline as TL
from cantus.operators.timeline import KEY

#: Slope and intercept that make a margin of scores a confidence.
MARGIN_SLOPE, MARGIN_INTERCEPT = 28.7942, -0.0738


def first_takes(takes: DataFrame, n: int, order: str = "name") -> DataFrame:
    """The first n takes in the order of their names; a top-n, so that each task keeps n rows."""
    return takes.orderBy(order).limit(n)


def events_of_segments(segments: DataFrame, source: str, slope: float = MARGIN_SLOPE, intercept: float = MARGIN_INTERCEPT, key: str = KEY) -> DataFrame:
    """Chord events of label segments (seq, start, end, label, and margin if known): N is silence, a final m minor, else major.

    A margin gives the confidence, and is kept at six digits; without one both are null.
    """
    margin = F.col("margin") if "margin" in segments.columns else F.lit(None).cast("double")
    silent, minor = F.col("label") == "N", F.col("label").endswith("m")
    root = F.when(~silent, F.when(minor, F.expr("substring(label, 1, char_length(label) - 1)")).otherwise(F.col("label")))
    return segments.select(
        key, "seq", "start", "end", root.alias("root"), F.when(silent, "no_chord").when(minor, "minor").otherwise("major").alias("quality"), F.lit(None).cast("string").alias("bass"), "label",
        S.logistic(margin, slope, intercept).alias("confidence"), F.lit(source).alias("source"), F.bround(margin, 6).alias("score_margin"),
    )


def chords_of_frames(frames: DataFrame, period: float, source: str = "frames", gate: float | None = -40.0, compression: str = "sqrt", penalty: float | None = 0.4, threshold: float = 0.5, least: float = 0.5, key: str = KEY) -> DataFrame:
    """Chord events of chroma frames (frame_no, chroma, rms, duration).

    Quiet frames are silenced, chroma compressed and scored; labels come from decoding (with a ``penalty``) or from a threshold and a majority;
    runs become segments, short ones join their neighbours, and margins become confidences.
    """
    x = FR.energy_gate(frames, gate, key) if gate is not None else frames
    x = x.withColumn("scores", FR.frame_scores(S.compress_chroma(F.col("chroma"), compression)))
    if penalty is not None:
        states = F.array(*[F.lit(s) for s in FR.STATES])
        labels = DE.decode_frames(x, penalty, key).select(key, "frame_no", F.element_at(states, F.col("state") + 1).alias("label"))
    else:
        labels = TL.smooth_labels(x.select(key, "frame_no", FR.best_state(F.col("scores"), threshold).alias("label")), key=key)
    labels = labels.join(frames.select(key, "frame_no", "duration"), [key, "frame_no"])
    segments = TL.merge_short(TL.frame_segments(labels, period, key=key), least, key)
    return events_of_segments(segments.join(FR.segment_margins(x, segments, period, key), [key, "seq"]), source, key=key)


def windowed_chords(events: DataFrame, windows: DataFrame, results: DataFrame, key: str = KEY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Merged timelines of windowed runs, a row per song of what the windows agree on, and the events of windows that ignored their range.

    Songs with such an event are in the third table alone.
    """
    bad = SE.ignored_range(events, windows, key=key)
    songs = bad.select(key).distinct()
    good = lambda df: df.join(songs, key, "left_anti")
    return SE.merge_windows(good(events), key=key), SE.roll_up(good(results), key), bad


def calibrate(events: DataFrame, ref: DataFrame, takes: DataFrame, width, key: str = KEY) -> tuple[tuple[float, float, int] | None, DataFrame, DataFrame]:
    """Fit of confidences on every first take of two in the order of names, and the calibration of the others before and after it.

    ``events`` has seq, start, end, label, confidence and margin; ``takes`` key and name, takes without events count in the order.
    """
    outcomes = SC.event_agreement(events, ref, width, key).join(SC.parity_split(takes, "name").select(key, "held_out"), key)
    fit = SC.fit_logistic(outcomes.filter("not held_out"))
    held = outcomes.filter("held_out")
    after = held.withColumn("confidence", F.when(F.col("margin").isNotNull(), S.logistic(F.col("margin"), fit[0], fit[1]))) if fit else held
    return fit, SC.calibration(held), SC.calibration(after)


#: Metrics of a corpus run, of which the last two are also summed.
METRICS = ["csr", "csr_triads", "segment_overlap", "change_precision", "change_recall", "change_f1", "ref_to_hyp", "hyp_to_ref", "reference_chords", "hypothesis_chords"]


def corpus_run(takes: DataFrame, ref: DataFrame, hyp: DataFrame, width, window, digits: int | None = 5, key: str = KEY) -> tuple[DataFrame, DataFrame]:
    """Scores of each take that has a reference, and their summary (mean, median, least, most, n and total of each metric). ``takes`` has key and name."""
    scores = takes.select(key, "name").join(PL.take_scores(ref, hyp, width, window, digits, key), key)
    return scores, SC.summarize(scores, METRICS, totals=True)


def playback_order(rows: DataFrame, key: str = KEY) -> DataFrame:
    """Rows by song, start and seq; a range sort over all songs."""
    return rows.orderBy(key, "start", "seq")


def interval_properties(rows: DataFrame) -> DataFrame:
    """Add duration (null where a bound is missing), has_timestamps, is_silence (label N or quality no_chord), and has_word_timestamps where there are words."""
    x = rows.withColumn("duration", S.duration(F.col("start"), F.col("end"))).withColumn("has_timestamps", F.col("start").isNotNull() & F.col("end").isNotNull())
    silent = [F.col(c) == v for c, v in (("label", "N"), ("quality", "no_chord")) if c in rows.columns]
    if silent:
        x = x.withColumn("is_silence", F.coalesce(silent[0] if len(silent) == 1 else silent[0] | silent[1], F.lit(False)))
    if "words" in rows.columns:
        x = x.withColumn("has_word_timestamps", F.coalesce((F.size("words") > 0) & F.forall("words", lambda w: w["start"].isNotNull() & w["end"].isNotNull()), F.lit(False)))
    return x


#: What makes a row of each layer unfit: (error, condition), the first that holds.
NOTE_NAMES = "C C# D D# E F F# G G# A A# B".split()


def validity(layer: str) -> Column:
    """Error of a row of a layer (chords, words, lines, beats, downbeats, bars, notes, tempos, audio, outcomes), null for a fit one."""
    c = F.col
    negative = lambda n: (f"negative {n}", c(n) < 0)
    turned = ("reversed", c("end") < c("start"))
    note = lambda n: (f"unknown {n}", c(n).isNotNull() & ~c(n).isin(NOTE_NAMES))
    midi = lambda n: (f"{n} out of range", ~c(n).between(0, 127))
    rules = {
        "chords": [negative("start"), turned, note("root"), note("bass")],
        "words": [negative("start"), turned], "lines": [negative("start"), turned],
        "beats": [negative("time"), ("position", c("position_in_bar") < 1)], "downbeats": [negative("time")],
        "bars": [negative("index"), negative("start"), turned], "notes": [negative("start"), turned, midi("pitch_midi"), midi("velocity")],
        "tempos": [("bpm", ~(c("bpm") > 0))], "audio": [negative("duration"), *((n, c(n) <= 0) for n in ("sample_rate", "channels", "bitrate")), negative("file_size")],
        "outcomes": [("seconds", c("seconds") <= 0), negative("correct_seconds"), ("too much correct", c("correct_seconds") > c("seconds") + 1e-9), ("confidence", ~c("confidence").between(0, 1))],
    }
    return F.coalesce(*(F.when(F.coalesce(bad, F.lit(False)), name) for name, bad in rules[layer]))


def split_valid(rows: DataFrame, layer: str) -> tuple[DataFrame, DataFrame]:
    """The fit rows of a layer, and the others with error."""
    x = rows.withColumn("error", validity(layer))
    return x.filter("error is null").drop("error"), x.filter("error is not null")


def usable(rows: DataFrame, layer: str) -> DataFrame:
    """Rows that a score can use: observations of positive length, words with a start, lines with a text; others are dropped, never given a value."""
    return rows.filter({"observations": "duration > 0", "words": "start is not null", "lines": "trim(coalesce(text, '')) != ''"}[layer])


def layer_labels(songs: DataFrame, chords: DataFrame, lines: DataFrame, tempos: DataFrame, key: str = KEY) -> DataFrame:
    """key, chords, confidence, lyrics, tempo: what a summary says of each layer; null for a layer without rows ('none detected' for chords).

    ``chords``: confidence (null: unknown), source; ``lines``: words (array); ``tempos``: bpm, alternatives (array), meter.
    """
    n = lambda x, noun: F.concat(x.cast("string"), F.lit(f" {noun}"), F.when(x == 1, "").otherwise("s"))
    c = PL.layer_summary(chords, key)
    from_ = F.when(F.col("sources") != "", F.concat(F.lit(" from "), "sources")).otherwise("")
    known = F.col("events") - F.col("unknown")
    average = F.format_string("%.2f average", "mean_confidence")
    sure = (
        F.when(known == 0, F.when(F.col("sources") != "", F.concat(F.lit("unknown ("), "sources", F.lit(")"))).otherwise("unknown"))
        .when(F.col("unknown") == 0, average).otherwise(F.concat(average, F.format_string(" over %d of %d events (%d unknown)", known, "events", "unknown")))
    )
    c = c.select(key, F.concat(F.col("events").cast("string"), F.lit(" events"), from_).alias("chords"), sure.alias("confidence"))
    text = lines.groupBy(key).agg(F.count("*").alias("s"), F.sum(F.greatest(F.lit(0), F.size(F.coalesce("words", F.array())))).alias("w")).select(key, F.concat(n(F.col("s"), "segment"), F.lit(", "), n(F.col("w"), "word")).alias("lyrics"))
    also = F.array_join(F.transform("alternatives", lambda b: F.format_string("%.1f", b)), ", ")
    speed = F.concat(F.format_string("%.1f BPM", "bpm"), F.when(F.size("alternatives") > 0, F.concat(F.lit(" (also "), also, F.lit(" BPM)"))).otherwise(""), F.when(F.col("meter") != "", F.concat(F.lit(" in "), "meter")).otherwise(""))
    t = tempos.groupBy(key).agg(F.max(speed).alias("tempo"))
    return songs.select(key).distinct().join(c, key, "left").join(text, key, "left").join(t, key, "left").fillna("none detected", ["chords"])


def transcripts(lines: DataFrame, key: str = KEY) -> DataFrame:
    """key, text, lines: a song's lines (seq, text) in order, trimmed, with single spaces between; blank ones are skipped."""
    x = usable(lines, "lines").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", F.trim("text").alias("text")))).alias("x"))
    return x.select(key, F.array_join(F.transform("x", lambda r: r["text"]), " ").alias("text"), F.size("x").cast("bigint").alias("lines"))


def track_position(time: Column, duration: Column, width: Column) -> Column:
    """Where a time is on a track of ``width``, inside of it; 0 without a duration."""
    return F.when(duration > 0, F.greatest(F.lit(0.0), F.least(width, time / duration * width))).otherwise(0.0)


def track_time(x: Column, duration: Column, width: Column) -> Column:
    """The time at a place of a track, inside of it; 0 without a width."""
    return F.when((width > 0) & (duration > 0), F.greatest(F.lit(0.0), F.least(duration, x / width * duration))).otherwise(0.0)
