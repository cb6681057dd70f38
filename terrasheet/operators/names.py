"""Names and dates from the lines that OCR read, and matches of descriptors with loosened thresholds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from .lineage import cut

#: Formats of written dates, tried in order.
DATE_FORMATS = ("MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy", "M/d/yyyy", "M-d-yyyy", "yyyy-M-d")


def parse_date(s: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """The date that a text is in one of the formats, in any case; a comma without a blank and bars are mended; null if none fits."""
    t = F.trim(F.regexp_replace(F.regexp_replace(s, r"\|", ""), r",\s*", ", "))
    t = F.initcap(F.regexp_replace(t, r"\s+", " "))
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)).cast("date") for f in formats])


def dated_lines(lines: DataFrame, key: str, order: str, line: str, keywords: list[str], least: float = 70.0, years: tuple[int, int] = (1965, 2020)) -> DataFrame:
    """(key, order, keyword, day): the dates of lines whose line before is like a keyword by partial ratio above `least`; the year lies strictly between `years`. A line that is like several keywords counts for each."""
    w = Window.partitionBy(key).orderBy(order)
    rows = lines.select(key, order, parse_date(F.col(line)).alias("day"), F.lag(F.lower(F.col(line))).over(w).alias("before"))
    rows = rows.where(F.col("day").isNotNull() & F.col("before").isNotNull() & (F.year("day") > years[0]) & (F.year("day") < years[1]))
    rows = rows.withColumn("keyword", F.explode(F.array(*[F.lit(k.lower()) for k in keywords])))
    return rows.where(X.partial_ratio(F.col("keyword"), F.col("before")) > least).select(key, order, "keyword", "day")


def dates_by_suffix(catalogue: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, days): for each asked (id, tile, suffix) the sorted dates of that suffix in catalogue (tile, suffix, day); a suffix that is null, empty or 0 stands for all."""
    every = F.coalesce(F.col("suffix"), F.lit("")).isin("", "0")
    sets = lambda *keys: catalogue.groupBy(*keys).agg(F.array_sort(F.collect_set("day")).alias("_d"))
    one, all_ = sets("tile", "suffix").withColumnRenamed("_d", "_one"), sets("tile").withColumnRenamed("_d", "_all")
    out = asked.join(one, ["tile", "suffix"], "left").join(all_, "tile", "left")
    return out.select("id", F.coalesce(F.when(every, F.col("_all")).otherwise(F.col("_one")), F.array().cast("array<date>")).alias("days"))


def words_like(lines: DataFrame, id_col: str, line: str, key: str, least: float) -> DataFrame:
    """(id, word, score): the words of each line that are most like the key by partial ratio, ties included, if they reach `least`.

    Words shorter than the key score 0. A word that is the key itself is the start
    of a split name: the next word is put behind it.
    """
    words = lines.select(id_col, F.posexplode(F.regexp_extract_all(F.col(line), F.lit(r"(\b\w+\b)"), F.lit(1))).alias("at", "word"))
    words = words.withColumn("after", F.lead("word").over(Window.partitionBy(id_col).orderBy("at")))
    score = F.when(F.length("word") < len(key), F.lit(0.0)).otherwise(X.partial_ratio(F.lit(key), F.col("word")))
    words = words.withColumn("score", score)
    best = F.max("score").over(Window.partitionBy(id_col))
    words = words.withColumn("best", best).where((F.col("score") == F.col("best")) & (F.col("score") >= least))
    return words.select(id_col, F.when(F.col("word") == key, F.concat("word", F.coalesce("after", F.lit("")))).otherwise(F.col("word")).alias("word"), "score")


def secondary_name(texts: DataFrame, id_col: str, text_list: str, key: str, threshold: float) -> DataFrame:
    """(id, name, way): a tile name from all texts of a sheet.

    Of the texts with a digit that are as long as the key once cleaned, that most
    like the key is the name if its ratio is above the threshold. Otherwise the
    longest text gives its first four digits and a letter, or else its first four
    digits, behind the key; failing these, the key and all short texts follow.
    """
    clean = F.transform(F.filter(F.col(text_list), lambda t: t.rlike("[0-9]")), lambda t: X.clean_name(t, key))
    cand = texts.select(id_col, F.explode(F.filter(clean, lambda t: F.length(t) >= len(key))).alias("name"))
    cand = cand.withColumn("score", X.fuzzy_ratio(F.col("name"), F.lit(key))).where(F.col("score") > threshold)
    top = cand.groupBy(id_col).agg(F.min_by("name", F.struct(-F.col("score"), F.col("name"))).alias("top"))
    longest = F.array_max(F.transform(F.col(text_list), lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]
    lettered, plain = F.regexp_extract(longest, "([0-9]{4}[A-Za-z])", 1), F.regexp_extract(longest, "([0-9]{4})", 1)
    short = F.concat_ws("", F.filter(F.col(text_list), lambda t: F.length(t) < len(key)))
    found = texts.join(top, id_col, "left").withColumns({"_l": lettered, "_p": plain})
    name = F.coalesce("top", F.when(F.col("_l") != "", F.concat(F.lit(key), F.upper("_l"))), F.when(F.col("_p") != "", F.concat(F.lit(key), F.col("_p"))), F.concat(F.lit(key + "_"), short))
    way = F.when(F.col("top").isNotNull(), "key").when(F.col("_l") != "", "lettered").when(F.col("_p") != "", "digits").otherwise("short")
    return found.select(id_col, name.alias("name"), way.alias("way"))


def index_tile_name(lines: DataFrame, id_col: str, line: str, key: str, least: float = 60.0) -> DataFrame:
    """(id, name): of each sheet's lines with four digits or more that most like the key, if its ratio is above `least`: its digits after the longest end of the key, of two characters or more, that they hold. Five digits that end in 8 or 7, a misread letter, lose it."""
    rows = lines.where(F.length(F.regexp_replace(line, "[^0-9]", "")) >= 4).withColumn("_s", X.fuzzy_ratio(F.col(line), F.lit(key))).where(F.col("_s") > least)
    best = rows.groupBy(id_col).agg(F.min_by(line, F.struct(-F.col("_s"), F.col(line))).alias("_l"))
    digits = F.regexp_replace("_l", "[^0-9]", "")
    ends = [key[i:] for i in range(len(key) - 1)]
    rest = F.coalesce(*[F.when(F.contains(digits, F.lit(e)), F.expr(f"substring(regexp_replace(_l, '[^0-9]', ''), instr(regexp_replace(_l, '[^0-9]', ''), '{e}') + {len(e)})")) for e in ends], digits)
    return best.select(id_col, F.when(rest.rlike("^[0-9]{4}[78]$"), F.substring(rest, 1, 4)).otherwise(rest).alias("name"))


def loosened_ratio(candidates: DataFrame, grp: str, start: float, enough: int = 3, by: float = 0.01, most: float = 1.0) -> DataFrame:
    """(grp, id, r_id, d1, d2, ratio): the matches whose nearest candidate is closer than `ratio` times the second; in each group ratio grows from `start` by `by` until `enough` match or it is `most`.

    candidates: (grp, id, r_id, dist), all that the gate lets through. They are
    ranked once: the ratio a group needs is read from its matches' own quotients.
    A point with a single candidate has no match.
    """
    w = Window.partitionBy(grp, "id").orderBy("dist", "r_id")
    two = candidates.withColumn("_n", F.row_number().over(w)).withColumn("d2", F.lead("dist").over(w)).where("_n = 1 AND d2 IS NOT NULL")
    return loosened_two(two.select(grp, "id", "r_id", F.col("dist").alias("d1"), "d2"), grp, start, enough, by, most)


def loosened_two(two: DataFrame, grp: str, start: float, enough: int = 3, by: float = 0.01, most: float = 1.0) -> DataFrame:
    """loosened_ratio from each point's best candidate and the costs of its two best: (grp, id, r_id, d1, d2)."""
    two = two.select(grp, "id", "r_id", "d1", "d2", F.when(F.col("d2") > 0, F.col("d1") / F.col("d2")).otherwise(1.0).alias("_q"))
    steps = int(round((most - start) / by))
    # the first step at which a point matches; only the counts by step are gathered
    need = two.withColumn("_step", F.greatest(F.ceil((F.col("_q") - start) / by - 1e-9), F.lit(0)).cast("int")).where(F.col("_step") <= steps)
    counts = need.groupBy(grp, "_step").agg(F.count(F.lit(1)).alias("_c"))
    so_far = counts.withColumn("_c", F.sum("_c").over(Window.partitionBy(grp).orderBy("_step")))
    reached = so_far.groupBy(grp).agg(F.coalesce(F.min(F.when(F.col("_c") >= enough, F.col("_step"))), F.lit(steps)).alias("_at"))
    return need.join(reached, grp).where(F.col("_step") <= F.col("_at")).select(grp, "id", "r_id", "d1", "d2", F.round(start + by * F.col("_at"), 9).alias("ratio"))


def loosened_radius(candidates: DataFrame, grp: str, radius: float, ratio: float, enough: int = 3, growth: float = 0.25, retries: int = 8) -> DataFrame:
    """(grp, id, r_id, d1, d2, radius): matches by ratio among the candidates within a radius that grows by `growth` of itself at first, in each group until `enough` match.

    candidates: (grp, id, r_id, dist, away), `away` the distance on the ground up
    to the largest radius. Each retry ranks those within its radius anew.
    """
    tries = candidates.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(retries)))).where(F.col("away") <= radius * (1 + growth * F.col("_k")))
    w = Window.partitionBy(grp, "_k", "id").orderBy("dist", "r_id")
    two = tries.withColumn("_n", F.row_number().over(w)).withColumn("d2", F.lead("dist").over(w)).where(F.col("d2").isNotNull() & (F.col("_n") == 1) & (F.col("dist") <= ratio * F.col("d2")))
    counts = two.groupBy(grp, "_k").agg(F.count(F.lit(1)).alias("_c"))
    reached = counts.groupBy(grp).agg(F.coalesce(F.min(F.when(F.col("_c") >= enough, F.col("_k"))), F.lit(retries)).alias("_at"))
    return two.join(reached, grp).where(F.col("_k") == F.col("_at")).select(grp, "id", "r_id", F.col("dist").alias("d1"), "d2", (radius * (1 + growth * F.col("_k"))).alias("radius"))


def loosened_radius_of(two: Callable[[DataFrame, float], DataFrame], left: DataFrame, grp: str, radius: float, ratio: float, enough: int = 3, growth: float = 0.25, retries: int = 8) -> DataFrame:
    """loosened_radius where `two` gives (grp, id, r_id, d1, d2) of left points and a radius: a group whose matches are enough is not looked at with a larger one."""
    done = None
    for k in range(retries + 1):
        far = radius * (1 + growth * k)
        got = cut(two(left, far).where(F.col("d1") <= ratio * F.col("d2")))
        full = got.groupBy(grp).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") >= enough).select(grp)
        rest = left.join(full, grp, "left_anti")
        last = k == retries or rest.isEmpty()
        own = (got if last else got.join(full, grp, "left_semi")).withColumn("radius", F.lit(float(far)))
        done = own if done is None else done.unionByName(own)
        if last:
            return done
        left = cut(rest)
    raise ValueError("retries must be 0 or more")
