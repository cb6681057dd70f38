"""Quality rules with thresholds that adapt to each language and source.

Native: DataFrame expressions only. A null text has no words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, cut

SYMBOLS = "#*$%&|<>"
#: Points of a sketch. Up to so many values a sketch is exact; beyond, its rank error is below 0.1 %.
SKETCH_K = 4096
#: A group with fewer texts takes the thresholds of its language, a language with fewer those of all texts.
LEAST_GROUP = 50
#: Tukey's fences: a text fails if a measure is further than WIDTH interquartile ranges above the upper quartile. The spread counts as `slack` at least, so that a group of nearly equal texts doesn't fail ordinary ones.
WIDTH = 4.0
MEASURES = {"symbol_ratio": 0.01, "dup_line_ratio": 0.04, "repeat_ratio": 0.04, "upper_ratio": 0.02, "word_length": 0.5}


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS), "")


def _repeated(words: Column) -> Column:
    """How many words lie in a 3-word window that occurs twice or more."""
    n = F.size(words)
    grams = F.transform(F.slice(words, 1, n - 2), lambda w, i: F.concat_ws(" ", w, F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(n >= 3, grams)


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The counts of every text, in columns beside the input's other columns, without the text.

    Windows are compared as text, by sorting them within the row: n log n for a text of any length.
    """
    others = [c for c in docs.columns if c != text_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(*others, text.alias("_text"))
    df = df.withColumn("_words", words_of(F.col("_text"))).withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.select(
        *others,
        "_words",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.regexp_replace("_text", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.length("_text") - F.length(F.regexp_replace("_text", r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
    )
    df = df.withColumn("_grams", _repeated(F.col("_words"))).drop("_words")
    grams = F.col("_grams")
    df = df.withColumn("_some", grams.isNotNull() & (F.size(F.array_distinct(grams)) < F.size(grams)))
    df = df.withColumn("_sorted", F.when(F.col("_some"), F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    s = F.col("_sorted")
    again = F.filter(s, lambda e, j: (e["g"] == F.get(s, j - 1)["g"]) | (e["g"] == F.get(s, j + 1)["g"]))
    covered = F.array_distinct(F.flatten(F.transform(again, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2))))
    return df.withColumn("n_repeat_words", F.when(F.col("_some"), F.size(covered)).otherwise(0).cast("long")).drop("_grams", "_some", "_sorted")


def _ratios(df: DataFrame) -> DataFrame:
    at_least = lambda c: F.greatest(F.col(c), F.lit(1))
    return df.withColumns(
        {
            "symbol_ratio": F.col("n_symbols") / at_least("word_chars"),
            "dup_line_ratio": F.col("n_dup_lines") / at_least("n_lines"),
            "repeat_ratio": F.col("n_repeat_words") / at_least("n_words"),
            "upper_ratio": F.col("n_upper") / at_least("word_chars"),
            "word_length": F.col("word_chars") / at_least("n_words"),
        }
    )


def _fences(sketches: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    out = [*keys, F.col("n").alias(f"{prefix}_n")]
    for m, slack in MEASURES.items():
        q1, q3 = (F.kll_sketch_get_quantile_double(m, F.lit(q)) for q in (0.25, 0.75))
        out.append((q3 + WIDTH * F.greatest(q3 - q1, F.lit(slack))).alias(f"{prefix}_{m}"))
    return sketches.select(*out)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row for each input row: the counts, base_failed, the fences used and `kept`.

    base_failed: fewer than 50 words, or over half of the words repeated. Texts
    that pass feed one quantile sketch for each language, source and measure;
    sketches merge into those of the language and of all texts, which serve
    groups of fewer than LEAST_GROUP texts. A null language or source is a group
    of its own. Empty texts fail the base rule; ties at a fence are kept.
    """
    slim = docs.select(F.col(id_col), F.col(lang_col).alias("_lang"), F.col(source_col).alias("_source"), F.col(text_col).alias("_body"))
    # counted once: both the sketches and the verdicts read these slim rows
    df = _ratios(cut(measures(slim, "_body")))
    df = df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    df = df.withColumns({"_l": F.to_json(F.array("_lang")), "_s": F.to_json(F.array("_source"))})
    passed = df.where(~F.col("base_failed"))
    by_source = passed.groupBy("_l", "_s").agg(F.count(F.lit(1)).alias("n"), *[F.kll_sketch_agg_double(m, F.lit(SKETCH_K)).alias(m) for m in MEASURES])
    merge = [F.sum("n").alias("n"), *[F.kll_merge_agg_double(m, F.lit(SKETCH_K)).alias(m) for m in MEASURES]]
    by_lang = by_source.groupBy("_l").agg(*merge)
    overall = by_lang.agg(*merge).where("n > 0")
    fences = (
        _fences(by_source, ["_l", "_s"], "s")
        .join(_fences(by_lang, ["_l"], "l"), "_l")
        .withColumn("_all", F.lit(1))
        .join(_fences(overall.withColumn("_all", F.lit(1)), ["_all"], "a"), "_all")
    )
    pick = {m: F.when(F.col("s_n") >= LEAST_GROUP, F.col(f"s_{m}")).when(F.col("l_n") >= LEAST_GROUP, F.col(f"l_{m}")).otherwise(F.col(f"a_{m}")).alias(f"most_{m}") for m in MEASURES}
    fences = fences.select("_l", "_s", *pick.values())
    judged = df.join(fences, ["_l", "_s"], "left")
    fine = F.lit(True)
    for m in MEASURES:
        fine = fine & (F.col(m) <= F.col(f"most_{m}"))
    return judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(fine, F.lit(True))).drop("_l", "_s").withColumnsRenamed({"_lang": "lang", "_source": "source"})
