"""Line dedup by an exact set-similarity join with prefix, position and length filters."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cantus.llm.store import spent, stable, written

#: Jaccard similarity of two lines' token sets at which the later one goes.
SIMILARITY = 0.9
#: Token frequencies are kept for so many hash buckets.
BUCKETS = 1 << 20
#: A sketch is cut into so many blocks to find lines that are like another one.
BLOCKS = 4
#: In groups of so many lines at most, all pairs are compared at once.
FEW = 64
#: Bits of the filter that lets only candidate lines through to verification; saturation costs time, not results.
FILTER_BITS = 1 << 22


def numbers(similarity: float) -> tuple[int, int]:
    f = Fraction(str(similarity))
    return f.numerator, f.denominator


def lines_of(docs: DataFrame) -> DataFrame:
    """rk (names document and text), doc_id, line_no, line for every line with a token; a text's lines are split at \\n."""
    keyed = docs.select("doc_id", "text", row_key().alias("rk")).filter("text is not null")
    return keyed.select("rk", "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).filter(F.btrim("line") != "")


def row_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit("-")))


def rarity(docs: DataFrame) -> DataFrame:
    """One row: hist, the array of how often tokens of each hash bucket occur, capped at 2**22."""
    tokens = docs.select(F.explode(F.split(F.lower(F.replace("text", F.lit("\n"), F.lit(" "))), " ")).alias("t")).filter("t != ''").select(F.pmod(F.xxhash64("t"), F.lit(BUCKETS)).cast("int").alias("b"))
    n = tokens.groupBy("b").agg(F.count("*").alias("n"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b"))
    dense = every.join(n, "b", "left").select("b", F.least(F.coalesce("n", F.lit(0)), F.lit(1 << 22)).cast("int").alias("n"))
    # a fixed number of rows, whatever the input
    return stable(dense.agg(F.expr("transform(array_sort(collect_list(struct(b, n))), x -> x.n)").alias("hist")))


def with_codes(lines: DataFrame, hist: DataFrame) -> DataFrame:
    """Add codes: the line's distinct tokens as numbers, rarest first; a code's high bits are its frequency, the low ones its hash."""
    lines = lines.withColumn("hist", hist.scalar())
    # between two spaces there is no token
    code = "array_distinct(transform(array_remove(split(lower(line), ' '), ''), t -> xxhash64(t)))"
    code = f"transform({code}, h -> shiftleft(cast(element_at(hist, cast(pmod(h, {BUCKETS}) as int) + 1) as bigint), 40) | (shiftright(h, 7) & 1099511627775L))"
    return lines.withColumn("codes", F.expr(f"sort_array({code})")).drop("hist")


#: A set's parity sketch: sets differ in at least as many codes as their sketches do in bits.
PARITIES = "aggregate(codes, 0L, (a, c) -> a ^ shiftleft(1L, cast(c & 63L as int)))"


def duplicate_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(rk, line_no) of every line that an earlier one makes superfluous.

    Lines are in the order of document id and line number. A line goes if any
    earlier line, kept or not, has equal text or a token set of ``similarity`` or more.
    """
    p, q = numbers(similarity)
    hist = rarity(docs)
    lines = lines_of(docs).withColumn("lid", F.xxhash64("line"))
    # any two sets that match share one of their n - ceil(similarity * n) + 1 rarest tokens
    coded = with_codes(lines, hist).withColumn("n", F.size("codes")).select(
        "lid", F.struct("doc_id", "line_no", "rk", "n", F.expr(PARITIES).alias("sketch"), F.expr(f"slice(codes, 1, n - cast(ceil(n * {p} / {q}) as int) + 1)").alias("prefix")).alias("x")
    )
    first = written(coded.groupBy("lid").agg(F.min("x").alias("x")).select("lid", "x.*"))
    rows = first.select("lid", "doc_id", "line_no", "n", "sketch", F.posexplode("prefix").alias("i", "code"))
    # lines that match differ in length by the similarity at most: where sorted lengths leap further, a token's lines fall apart
    sized = Window.partitionBy("code").orderBy("n", "lid")
    apart = (F.col("before").isNull() | (F.col("n") * p > F.col("before") * q)).cast("int")
    rows = rows.withColumn("before", F.lag("n").over(sized)).withColumn("run", F.sum(apart).over(sized)).drop("before")
    group = Window.partitionBy("code", "run")
    me = F.struct("doc_id", "line_no", "lid", "n", "i", "sketch")
    led = rows.withColumn("size", F.count("*").over(group)).withColumn("lead", F.min(me).over(group)).filter("size > 1 AND lead.lid != lid")
    # of two lines without a chance nothing is left to do
    led = led.withColumn("near", may_match(F.col("lead"), me, p, q)).filter("near OR size > 2")
    star = written(led.select("code", "run", *LINE, F.col("lead.lid").alias("lead"), "near", "size"))
    # in small groups all pairs are compared at once, at most FEW / 2 a row
    few = star.filter(F.col("size").between(3, FEW)).select("code", "run", me.alias("me"))
    pairs = star.filter("near").select("lid", F.col("lead").alias("other")).union(alike(few, few, p, q))
    gone = written(matching(docs, hist, pairs.distinct(), p, q))
    # lines of larger groups that their earliest line doesn't explain are compared with all other earlier ones of the groups; those that no other one is like leave before
    open_ = (F.col("n") > short(p, q)) | like_another()
    rest = written(star.filter(F.col("size") > FEW).withColumn("open", open_).filter("open").select("code", "run", "lid", me.alias("me")))
    spent(star)
    more = written(alike(rest.join(gone, "lid", "left_anti"), rest, p, q))
    if not more.isEmpty():
        gone = written(gone.union(matching(docs, hist, more, p, q)).distinct())
    spent(rest)
    where = first.select("lid", F.struct("doc_id", "line_no", "rk").alias("at"))
    later = lines.select("rk", "line_no", "lid", F.struct("doc_id", "line_no", "rk").alias("here")).join(where, "lid").join(gone.withColumn("near", F.lit(True)), "lid", "left")
    return later.filter((F.col("here") > F.col("at")) | F.col("near")).select("rk", "line_no").distinct()


def alike(mine: DataFrame, others: DataFrame, p: int, q: int) -> DataFrame:
    """(lid, other): lines of ``mine`` and earlier ones of the same group in ``others`` that may match; both have code, run, me."""
    x = mine.select("code", "run", "me").join(others.select("code", "run", F.col("me").alias("o")), ["code", "run"])
    return x.filter((F.col("o") < F.col("me")) & may_match(F.col("o"), F.col("me"), p, q)).select(F.col("me.lid").alias("lid"), F.col("o.lid").alias("other")).distinct()


def short(p: int, q: int) -> int:
    """The longest lines whose sketches differ in fewer than BLOCKS bits from those of all lines that they match."""
    return max((n for n in range(1 << 12) if (n + n * q // p) * (q - p) < BLOCKS * (p + q)), default=0)


def like_another() -> Column:
    """Whether another line of the group has one of the sketch's BLOCKS blocks alike, as sketches that differ in fewer bits must. The groups are in one task each already."""
    bits = 64 // BLOCKS
    same = F.lit(False)
    for k in range(BLOCKS):
        block = F.shiftrightunsigned("sketch", k * bits).bitwiseAND(F.lit((1 << bits) - 1))
        same = same | (F.count("*").over(Window.partitionBy("code", "run", block)) > 1)
    return same


#: What is known of a line beside a token.
LINE = ["doc_id", "line_no", "lid", "n", "i", "sketch"]


def may_match(a: Column, b: Column, p: int, q: int) -> Column:
    """Length, position and sketch filters; none drops a match.

    a, b: structs of n (size), i (place of a shared token among the sorted codes), sketch.
    """
    small, large = F.least(a["n"], b["n"]), F.greatest(a["n"], b["n"])
    both = a["n"] + b["n"]
    # the shared token is the k-th of each side: at most min(i) + 1 shared up to it, and the shorter rest after it
    bound = F.least(a["i"], b["i"]) + F.least(a["n"] - a["i"], b["n"] - b["i"])
    differ = F.bit_count(a["sketch"].bitwiseXOR(b["sketch"]))
    return (small * q >= large * p) & (bound * (p + q) >= both * p) & (differ * (p + q) <= both * (q - p))


def matching(docs: DataFrame, hist: DataFrame, pairs: DataFrame, p: int, q: int) -> DataFrame:
    """lid of the pairs (lid, other) whose token sets reach the similarity.

    The candidates' lines are found again in the texts through a bit filter of fixed size.
    """
    pairs = written(pairs)
    ids = pairs.select(F.explode(F.array("lid", "other")).alias("lid")).distinct()
    bit = F.pmod("lid", F.lit(FILTER_BITS))
    words = ids.select((bit / 64).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(pmod(lid, {FILTER_BITS}) % 64 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    every = docs.sparkSession.range(FILTER_BITS // 64).select(F.col("id").cast("int").alias("w")).join(words, "w", "left")
    table = stable(every.agg(F.expr("transform(array_sort(collect_list(struct(w, coalesce(b, 0L) as b))), x -> x.b)").alias("bits")))
    lines = lines_of(docs).select(F.xxhash64("line").alias("lid"), "line").withColumn("bits", table.scalar())
    lines = lines.filter(F.expr(f"shiftright(element_at(bits, cast(pmod(lid, {FILTER_BITS}) / 64 as int) + 1), cast(pmod(lid, {FILTER_BITS}) % 64 as int)) & 1L = 1L")).drop("bits")
    found = lines.join(ids, "lid", "left_semi").groupBy("lid").agg(F.min("line").alias("line"))
    sets = written(with_codes(found, hist).select("lid", "codes"))
    x = pairs.join(sets, "lid").join(sets.select(F.col("lid").alias("other"), F.col("codes").alias("codes2")), "other")
    common = F.size(F.array_intersect("codes", "codes2"))
    return x.filter(common * q >= (F.size("codes") + F.size("codes2") - common) * p).select("lid").distinct()


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents with later copies and near copies of lines removed from their texts; adds n_lines_removed.

    A line is compared as its set of lower-cased words between spaces;
    lines without one are kept, and don't count. Null texts stay null. Rows that repeat both
    doc_id and text are one document: its lines are kept in each of the rows.
    Documents whose every worded line went keep what is left, an empty text at
    least. All columns of the input are returned; a column n_lines_removed there is replaced.
    """
    gone = duplicate_lines(docs, similarity).groupBy("rk").agg(F.collect_set("line_no").alias("gone"))
    docs = docs.drop("n_lines_removed")
    # one struct holds the input, so that no name of it can clash
    x = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), row_key().alias("key"), "text")
    x = x.join(gone, x["key"] == gone["rk"], "left").select("row", "text", "gone")
    kept = F.expr("array_join(transform(filter(transform(split(text, '\\n'), (l, i) -> struct(l as l, i as i)), x -> not array_contains(gone, x.i)), x -> x.l), '\\n')")
    x = x.withColumn("text", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept)).withColumn("n", F.greatest(F.coalesce(F.size("gone"), F.lit(0)), F.lit(0)))
    return x.select(*(F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns), F.col("n").alias("n_lines_removed"))
