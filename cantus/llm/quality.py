"""Quality rules on the lines that many documents of a host share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Space and the controls 9 to 13 separate words.
GAP = r"[\x20\x09-\x0D]+"
TRIM = " \t\n\x0b\f\r"


def words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(TRIM))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP))


def repeated_words(df: DataFrame, words_col: str, out: str) -> DataFrame:
    """Add how many words stand in a 3-word window that the same text has twice or more.

    Window hashes are sorted with their positions inside the row; equal neighbours are the repeats.
    Texts without a repeated window never sort.
    """
    df = df.withColumn("_h", F.transform(words_col, lambda w: F.xxhash64(w)))
    df = df.withColumn("_g", F.expr("transform(slice(_h, 1, greatest(size(_h) - 2, 0)), (x, i) -> xxhash64(x, _h[i + 1], _h[i + 2]))"))
    df = df.withColumn("_s", F.expr("if(size(array_distinct(_g)) = size(_g), null, sort_array(transform(_g, (x, i) -> struct(x as g, i as i))))"))
    df = df.withColumn("_p", F.expr("filter(transform(_s, (x, i) -> if(x.g = get(_s, i - 1).g or x.g = get(_s, i + 1).g, x.i, -1)), x -> x >= 0)"))
    return df.withColumn(out, F.expr("coalesce(size(array_distinct(flatten(transform(_p, p -> array(p, p + 1, p + 2))))), 0)").cast("long")).withColumn(
        out, F.when(F.col(out) < 0, 0).otherwise(F.col(out))
    ).drop("_h", "_g", "_s", "_p")


def line_rules(docs: DataFrame, host: str = "source", max_docs: int = 25, min_left: float = 0.5) -> DataFrame:
    """Rule features and a verdict per document.

    Lines are normalised (lower case, digits to 0, white space folded) and
    hashed; a line that more than ``max_docs`` distinct documents of a host hold
    is removed, and a document is rejected when less than ``min_left`` of its
    line characters are left. Adds n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, shared_chars, line_chars, kept.

    Null texts have no words and fail. A null host is a host of its own.
    Rows that repeat all of doc_id, host and text are one document for the counts and get the
    same verdict. Other columns of the input are ignored.
    """
    base = docs.select("doc_id", F.col(host).alias("host"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("rk", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("host", F.lit("-")), "text"))
    lines = base.select("rk", "host", F.explode(F.expr("array_distinct(filter(split(text, '\\n'), l -> btrim(l, ' \\t\\n\\u000b\\f\\r') != ''))")).alias("line"))
    norm = F.regexp_replace(F.lower(F.btrim("line", F.lit(TRIM))), r"[0-9]+", "0")
    lines = lines.select("rk", "host", F.xxhash64(F.regexp_replace(norm, GAP, " ")).alias("lh"), F.char_length("line").alias("chars"))
    lines = lines.groupBy("host", "lh", "rk").agg(F.max("chars").alias("chars"))
    often = lines.groupBy("host", "lh").agg(F.count("*").alias("n")).filter(F.col("n") > max_docs).select(F.col("host").alias("oh"), F.col("lh").alias("ol"))
    marked = lines.join(often, lines["host"].eqNullSafe(often["oh"]) & (lines["lh"] == often["ol"]), "left")
    spoilt = marked.groupBy(F.col("rk").alias("_rk")).agg(F.sum("chars").alias("line_chars"), F.sum(F.when(F.col("ol").isNotNull(), F.col("chars")).otherwise(0)).alias("shared_chars"))

    x = base.withColumn("w", words(F.col("text")))
    x = x.withColumn("n_words", F.size("w").cast("long")).withColumn("word_chars", F.char_length(F.array_join("w", "")).cast("long"))
    x = x.withColumn("n_symbols", (F.char_length("text") - F.char_length(F.translate("text", "#*$%&|<>", ""))).cast("long"))
    x = x.withColumn("_l", F.expr("filter(split(text, '\\n'), l -> btrim(l, ' \\t\\n\\u000b\\f\\r') != '')"))
    x = x.withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long")).drop("_l")
    x = repeated_words(x, "w", "n_repeat_words").drop("w", "text")
    x = x.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    x = x.join(spoilt, x["rk"] == spoilt["_rk"], "left")
    left = F.coalesce("line_chars", F.lit(0)) - F.coalesce("shared_chars", F.lit(0))
    kept = ~F.col("base_failed") & (left >= min_left * F.coalesce("line_chars", F.lit(0)))
    return x.withColumn("kept", kept).drop("rk", "_rk")
