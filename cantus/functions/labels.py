"""Chord labels as column expressions.

Labels repeat endlessly while their vocabulary is small: ``with_parsed`` parses the
distinct ones and joins the result back, and pair scores are made once for each distinct pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of the pitch classes 0 to 11, and other spellings of them.
NOTES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
SPELLINGS = {"Cb": 11, "Db": 1, "Eb": 3, "Fb": 4, "Gb": 6, "Ab": 8, "Bb": 10, "E#": 5, "B#": 0, "Dbb": 0}
#: Texts that mean that no chord sounds.
NO_CHORD = ["n", "nc", "no chord", "nochord", "none", "silence", "x"]
#: Signs and what they stand for.
SIGNS = {"♯": "#", "♭": "b", "♮": "", "Δ": "maj", "°": "dim"}
#: Suffix spellings of each quality, the one that is written first.
QUALITY_SUFFIXES = {
    "major": ["", "maj", "major", "M"],
    "minor": ["m", "min", "-", "minor"],
    "7": ["7", "dom7"],
    "maj7": ["maj7", "M7", "ma7"],
    "m7": ["m7", "min7", "-7"],
    "sus2": ["sus2"],
    "sus4": ["sus4", "sus"],
    "dim": ["dim", "o"],
    "aug": ["aug", "+"],
    "add9": ["add9"],
    "6": ["6", "maj6"],
    "m6": ["m6", "min6"],
    "9": ["9"],
    "m9": ["m9", "min9"],
}
#: Semitones of each quality, and of suffixes beyond the qualities.
INTERVALS = {
    "major": [0, 4, 7],
    "minor": [0, 3, 7],
    "7": [0, 4, 7, 10],
    "maj7": [0, 4, 7, 11],
    "m7": [0, 3, 7, 10],
    "sus2": [0, 2, 7],
    "sus4": [0, 5, 7],
    "dim": [0, 3, 6],
    "aug": [0, 4, 8],
    "add9": [0, 2, 4, 7],
    "6": [0, 4, 7, 9],
    "m6": [0, 3, 7, 9],
    "9": [0, 2, 4, 7, 10],
    "m9": [0, 2, 3, 7, 10],
}
EXTENSIONS = {
    "5": [0, 7],
    "7": [0, 4, 7, 10],
    "9": [0, 2, 4, 7, 10],
    "11": [0, 2, 4, 5, 7, 10],
    "13": [0, 2, 4, 7, 9, 10],
    "maj7": [0, 4, 7, 11],
    "maj9": [0, 2, 4, 7, 11],
    "maj13": [0, 2, 4, 7, 9, 11],
    "m7": [0, 3, 7, 10],
    "m9": [0, 2, 3, 7, 10],
    "m11": [0, 2, 3, 5, 7, 10],
    "minmaj7": [0, 3, 7, 11],
    "dim7": [0, 3, 6, 9],
    "hdim7": [0, 3, 6, 9],
    "7(#9)": [0, 3, 4, 7, 10],
    "7(#5)": [0, 4, 8, 10],
    "sus4(b7)": [0, 5, 7, 10],
}
#: Semitones of the scale degrees 1 to 7.
DEGREES = [0, 2, 4, 5, 7, 9, 11]
#: Quality words of the colon notation, and flats with their sharp names.
COLON_QUALITIES = {"maj": "", "major": "", "min": "m", "minor": "m", "min7": "m7", "min6": "m6", "min9": "m9", "min11": "m11"}
FLATS = {"Cb": "B", "Db": "C#", "Eb": "D#", "Fb": "E", "Gb": "F#", "Ab": "G#", "Bb": "A#"}
#: Pitch classes written flat in flat keys, and the tonics of those keys.
FLAT_NAMES = {1: "Db", 3: "Eb", 6: "Gb", 8: "Ab", 10: "Bb"}
FLAT_MAJOR, FLAT_MINOR = [1, 3, 5, 8, 10], [0, 2, 3, 5, 7, 10]
#: The triad quality under each richer one.
SIMPLER = {"7": "major", "maj7": "major", "add9": "major", "6": "major", "9": "major", "m7": "minor", "m6": "minor", "m9": "minor"}

PITCH = {n: i for i, n in enumerate(NOTES)} | SPELLINGS
SUFFIX_QUALITY = {s: q for q, many in QUALITY_SUFFIXES.items() for s in many}
QUALITY_SUFFIX = {q: many[0] for q, many in QUALITY_SUFFIXES.items()}


def lookup(table: dict, key: Column, kind: str = "string") -> Column:
    """The table's value for a key, null without one."""
    flat = [F.lit(x) for k, v in table.items() for x in (k, v)] if not isinstance(next(iter(table.values())), list) else [y for k, v in table.items() for y in (F.lit(k), F.array(*[F.lit(x) for x in v]))]
    return F.try_element_at(F.create_map(*flat), key).cast(kind)


def pitch_class(note: Column) -> Column:
    """Pitch class of a note in any accepted spelling; null if it is none. The first letter may be small."""
    x = signs(F.trim(note))
    return lookup(PITCH, F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 9)), "int")


def note_name(pc: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(n) for n in NOTES]), pc + 1)


def canonical_note(note: Column) -> Column:
    """Sharp name of a note; null if unknown, for quarantine."""
    return note_name(pitch_class(note))


def signs(text: Column) -> Column:
    for sign, plain in SIGNS.items():
        text = F.replace(text, F.lit(sign), F.lit(plain))
    return text


def parse(label: Column) -> Column:
    """struct(root, quality, bass, extension) of a label. An unknown root spelling gives quality 'unknown'."""
    x = signs(F.trim(label))
    root = canonical_note(F.regexp_extract(x, r"^([A-Ga-g][#b]{0,2})", 1))
    rest = F.regexp_extract(x, r"^[A-Ga-g][#b]{0,2}(.*)$", 1)
    slash = F.instr(rest, "/") > 0
    bass_text = F.regexp_extract(rest, r"^[^/]*/(.*)$", 1)
    good = ~slash | bass_text.rlike(r"^[A-Ga-g][#b]{0,2}$")
    suffix = F.regexp_extract(rest, r"^([^/]*)", 1)
    quality = quality_of(suffix)
    silent = F.lower(x).isin(NO_CHORD)
    known = ~silent & root.isNotNull()
    text = lambda c: F.lit(c).cast("string")
    return F.struct(
        F.when(known, root).alias("root"),
        F.when(silent, "no_chord").when(~known | root.isNull(), "unknown").when(~good, "other").otherwise(F.coalesce(quality, F.lit("other"))).alias("quality"),
        F.when(known & slash & good, canonical_note(bass_text)).alias("bass"),
        F.when(known & ~good, rest).when(known & quality.isNull(), suffix).otherwise(text(None)).alias("extension"),
    )


def quality_of(suffix: Column) -> Column:
    """Quality that a suffix spells: as it is, else in lower case; null if none."""
    return F.coalesce(lookup(SUFFIX_QUALITY, suffix), lookup(SUFFIX_QUALITY, F.lower(suffix)))


def with_parsed(df: DataFrame, label: str, out: str = "chord") -> DataFrame:
    """Add ``out``, the parsed label, by way of the distinct labels; Spark broadcasts these if they are small."""
    few = df.select(label).distinct().withColumn(out, parse(F.col(label)))
    return df.join(few, label, "left")


def render(root: Column, quality: Column, bass: Column, extension: Column) -> Column:
    """Label of its parts: N for silence, ? without root, no slash when the bass is the root."""
    suffix = F.when(quality == "other", F.coalesce(extension, F.lit(""))).otherwise(F.coalesce(lookup(QUALITY_SUFFIX, quality), F.lit("")))
    slash = F.when(bass.isNotNull() & (bass != root), F.concat(F.lit("/"), bass)).otherwise("")
    return F.when(quality == "no_chord", "N").when(root.isNull(), "?").otherwise(F.concat(root, suffix, slash))


def render_event(root: Column, quality: Column, bass: Column) -> Column:
    """As render(), for events: the suffix of 'other' is empty."""
    return render(root, quality, bass, F.lit(""))


def transpose_note(note: Column, semitones: Column) -> Column:
    return note_name(F.pmod(pitch_class(note) + semitones, F.lit(12)))


def transpose(label: Column, semitones: Column) -> Column:
    """Label moved by semitones; other and unknown chords as they are, silence as N."""
    p = parse(label)
    moved = render(transpose_note(p["root"], semitones), p["quality"], transpose_note(p["bass"], semitones), F.lit(None).cast("string"))
    return F.when(p["quality"] == "no_chord", "N").when(p["quality"].isin("other", "unknown"), label).otherwise(moved)


def from_colon(value: Column) -> Column:
    """Label of the colon notation (``Bb:min7``): a degree bass stays text."""
    x = F.trim(value)
    sharp = lambda c: F.coalesce(lookup(FLATS, c), c)
    root, rest = sharp(F.regexp_extract(x, r"^([^:]*)", 1)), F.regexp_extract(x, r"^[^:]*:(.*)$", 1)
    word, bass = F.regexp_extract(rest, r"^([^/]*)", 1), F.regexp_extract(rest, r"^[^/]*/(.*)$", 1)
    full = F.concat(root, F.coalesce(lookup(COLON_QUALITIES, word), word), F.when(bass != "", F.concat(F.lit("/"), sharp(bass))).otherwise(""))
    return F.when(x.isin("N", "N*", ""), "N").otherwise(full)


def pitch_classes(label: Column, parsed: Column | None = None) -> Column:
    """Distinct pitch classes of a chord; empty without a root. A bracket replaces the voicing: its degrees and the root, less those with a star."""
    p = parse(label) if parsed is None else parsed
    ext = F.coalesce(p["extension"], F.lit(""))
    head = F.regexp_replace(F.regexp_extract(ext, r"^([^(/]*)", 1), "^min", "m")
    kind = "array<int>"
    seven = F.when(F.instr(head, "7") > 0, F.array(*map(F.lit, INTERVALS["7"]))).otherwise(F.array(*map(F.lit, INTERVALS["major"])))
    base = F.coalesce(lookup(INTERVALS, p["quality"], kind), lookup(EXTENSIONS, head, kind), lookup(INTERVALS, quality_of(head), kind), seven)
    inner = F.regexp_extract(ext, r"\(([^)]*)\)", 1)
    toks = F.filter(F.transform(F.split(inner, ","), lambda t: F.trim(t)), lambda t: t.rlike(r"^\**[b#]*[0-9]+$"))

    def semis(t: Column) -> Column:
        degree = F.pmod(F.regexp_extract(t, r"([0-9]+)$", 1).cast("int") - 1, F.lit(7))
        up, down = F.length(F.regexp_replace(t, "[^#]", "")), F.length(F.regexp_replace(t, "[^b]", ""))
        return F.pmod(F.element_at(F.array(*map(F.lit, DEGREES)), degree + 1) + up - down, F.lit(12))

    starred = lambda t: F.startswith(t, F.lit("*"))
    add, omit = F.transform(F.filter(toks, lambda t: ~starred(t)), semis), F.transform(F.filter(toks, starred), semis)
    voiced = F.when((p["quality"] == "other") & ext.rlike(r"\([^)]*\)"), F.array_except(F.array_union(add, F.array(F.lit(0))), omit)).otherwise(base)
    root = pitch_class(p["root"])
    pcs = F.array_sort(F.array_distinct(F.transform(voiced, lambda i: F.pmod(i + root, F.lit(12)))))
    return F.when(p["root"].isNull(), F.array().cast(kind)).otherwise(pcs)


def bass_class(label: Column, root: Column, bass: Column) -> Column:
    """Pitch class of a slash: a note, or a degree of the scale on the root."""
    last = F.regexp_extract(label, r"/([b#]?[1-7])$", 1)
    degree = F.element_at(F.array(*map(F.lit, DEGREES)), F.when(last != "", F.regexp_extract(last, "([1-7])$", 1).cast("int")).otherwise(1))
    alter = F.when(F.startswith(last, F.lit("#")), 1).when(F.startswith(last, F.lit("b")), -1).otherwise(0)
    return F.when(bass.isNotNull(), pitch_class(bass)).when(last != "", F.pmod(root + degree + alter, F.lit(12)))


def features(labels: DataFrame, label: str = "label") -> DataFrame:
    """label, f: what scoring needs of each distinct label of a column. Each step is a row of its own (explode), so that Catalyst doesn't copy parse() into every use."""
    x = labels.select(label).distinct().select(F.col(label).alias("label"), F.explode(F.array(parse(F.col(label)))).alias("p"))
    x = x.select("label", "p", F.explode(F.array(F.struct(pitch_classes(F.col("label"), F.col("p")).alias("pcs"), pitch_class(F.col("p.root")).alias("root"), pitch_class(F.col("p.bass")).alias("bass")))).alias("s"))
    slash = bass_class(F.col("label"), F.col("s.root"), F.col("p.bass"))
    return x.select("label", F.struct("s.pcs", "s.root", F.col("p.quality").alias("q"), "s.bass", slash.alias("slash")).alias("f"))


def equality(ref: Column, hyp: Column, r: Column, h: Column) -> Column:
    """Score of two labels with features(): 0, 1, and up to 3 with the bonuses for sounding basses.

    Three shared pitch classes match, two where the reference is augmented or
    diminished. Two match too if the reference's bass, not its root, sounds in the
    hypothesis and the reference has no bracket.
    """
    both = F.size(F.array_intersect(r["pcs"], h["pcs"]))
    need = F.when(r["q"].isin("aug", "dim"), 2).otherwise(3)
    rescued = (both == 2) & ~F.contains(ref, F.lit("(")) & r["slash"].isNotNull() & (r["slash"] != r["root"]) & F.array_contains(h["pcs"], r["slash"])
    bonus = lambda a, b: F.when(a["bass"].isNotNull() & (a["bass"] != a["root"]) & F.array_contains(b["pcs"], a["bass"]), 1.0).otherwise(0.0)
    same = F.when(ref == hyp, 1.0).otherwise(0.0)
    return (
        F.when((ref == "N") | (hyp == "N"), same).when((F.size(r["pcs"]) == 0) | (F.size(h["pcs"]) == 0), same)
        .when((both >= need) | F.coalesce(rescued, F.lit(False)), 1.0 + bonus(r, h) + bonus(h, r)).otherwise(0.0)
    )


def with_equality(pairs: DataFrame, ref: str = "ref_label", hyp: str = "hyp_label", out: str = "score", labels: DataFrame | None = None) -> DataFrame:
    """Add the equality() of each pair of labels; null for null labels. ``labels`` has a column label with all of them, where that is cheaper to read than the pairs."""
    known = features(pairs.select(F.explode(F.array(ref, hyp)).alias("label")) if labels is None else labels)
    x = pairs.join(known.toDF(ref, "_r"), ref, "left").join(known.toDF(hyp, "_h"), hyp, "left")
    return x.select(*pairs.columns, equality(F.col(ref), F.col(hyp), F.col("_r"), F.col("_h")).alias(out))


def triad_scoring(label: Column) -> Column:
    """Scoring view: the label before a bracket or slash; only a plain minor keeps its m."""
    head = F.regexp_extract(label, r"^([^(/]*)", 1)
    p = parse(head)
    return F.when(p["quality"] == "no_chord", "N").when(p["root"].isNull(), label).when(p["quality"] == "minor", F.concat(p["root"], F.lit("m"))).otherwise(p["root"])


def triad_chart(label: Column) -> Column:
    """Chart view: every minor family keeps its m."""
    x = F.when(label.isin("N", "N.C.", "NC"), "N").otherwise(label)
    p = parse(x)
    return F.when(p["quality"] == "no_chord", "N").when(p["root"].isNull(), x).when(p["quality"].isin("minor", "m7", "m6", "m9"), F.concat(p["root"], F.lit("m"))).otherwise(p["root"])


def simplify(quality: Column) -> Column:
    """The triad quality under a richer one; others as they are."""
    return F.coalesce(lookup(SIMPLER, quality), quality)


def prefers_flats(tonic: Column, mode: Column) -> Column:
    pc, m = lookup(PITCH, tonic, "int"), F.lower(F.trim(F.coalesce(mode, F.lit(""))))
    return F.coalesce((F.startswith(m, F.lit("min")) & pc.isin(FLAT_MINOR)) | (F.startswith(m, F.lit("maj")) & pc.isin(FLAT_MAJOR)), F.lit(False))


def spell_note(note: Column, flats: Column) -> Column:
    return F.when(flats, F.coalesce(lookup(FLAT_NAMES, lookup(PITCH, note, "int")), note)).otherwise(note)


def spell_label(label: Column, flats: Column) -> Column:
    """Root and bass respelled for a flat key; the suffix stays."""
    head, bass = F.regexp_extract(label, r"^([^/]*)", 1), F.regexp_extract(label, r"^[^/]*/(.*)$", 1)
    root = F.regexp_extract(head, r"^(.[#b]?)", 1)
    done = F.concat(spell_note(root, F.lit(True)), F.substring(head, F.length(root) + 1, F.length(head)), F.when(bass != "", F.concat(F.lit("/"), spell_note(bass, F.lit(True)))).otherwise(""))
    return F.when(flats & ~label.isin("N", "?", "") & lookup(PITCH, root, "int").isNotNull(), done).otherwise(label)


def spell_key(tonic: Column, mode: Column) -> Column:
    known = F.coalesce((tonic != "") & (mode != "") & (F.lower(F.trim(mode)) != "unknown"), F.lit(False))
    return F.when(known, F.concat_ws(" ", spell_note(tonic, prefers_flats(tonic, mode)), mode)).otherwise("unknown")
