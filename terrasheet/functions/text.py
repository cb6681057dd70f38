"""Names, keys and dates read by OCR, as column expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: Characters that OCR confuses in tile names, and what they stand for.
CONFUSED, MEANT = "OTI€QZ", "011E07"
#: World-file extension by image extension.
WORLD_FILES = {"tif": "tfw", "tiff": "tfw", "png": "pgw", "jpg": "jgw", "jpeg": "jgw"}
MONTH_DATE = r"(?i)\b(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.? +(\d{1,2}), *(\d{4})"
#: Fixed value: dates whose month may be cut off to its last letters, `ary` or `ber`.
LOOSE_DATE = r"(?i)[A-Z]{0,10}(?:January|February|March|April|May|June|July|August|September|October|November|December|ary|ber)\s+\d{1,2},\s+\d{4}"


def leading_digits(s: Column) -> Column:
    return F.regexp_extract(s, "^([0-9]*)", 1)


def leading_digits_or_null(s: Column) -> Column:
    return F.nullif(leading_digits(s), F.lit(""))


def index_key(path: Column) -> Column:
    """The digits at the start of a file's name, before its first dot and underscore."""
    return leading_digits(F.substring_index(F.substring_index(F.substring_index(path, "/", -1), ".", 1), "_", 1))


def is_index_sheet(file: Column) -> Column:
    """Whether a file is an index sheet by its name: it holds `IND` or `_1.`, or is shorter than 12 characters; never an unsure one."""
    return (file.contains("IND") | file.contains("_1.") | (F.length(file) < 12)) & ~file.contains("unsure")


def all_digits(s: Column) -> Column:
    return F.nullif(F.regexp_replace(s, "[^0-9]", ""), F.lit(""))


def fix_confusions(s: Column) -> Column:
    return F.translate(F.upper(s), CONFUSED, MEANT)


def keep_letters(s: Column, n: int) -> Column:
    """At most n letters stay after the last digit."""
    return F.regexp_replace(s, f"([0-9])([A-Za-z]{{{n}}})[A-Za-z]*$", "$1$2")


def clean_name(s: Column, key: str) -> Column:
    """A tile name from OCR text: a final ` 8` is a B; other characters than letters, digits and _ go, and what stands before the key; confusions are mended; seven characters after the key stay, one of them a letter at the end."""
    t = F.regexp_replace(s, " 8$", "B")
    t = F.regexp_replace(t, "[^A-Za-z0-9_]", "")
    at = F.instr(t, key)
    t = F.when(at > 0, F.substring(t, at, F.length(t))).otherwise(t)
    t = fix_confusions(t)
    return keep_letters(F.substring(t, 1, len(key) + 7), 1)


def split_name(s: Column) -> tuple[Column, Column]:
    """A name without its final letter, and that letter; the letter is null if there is none."""
    has = s.rlike("[A-Za-z]$")
    return F.when(has, F.substring(s, 1, F.length(s) - 1)).otherwise(s), F.when(has, F.right(s, F.lit(1)))


def secondary_key(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, "[^0-9_]", ""), "__", "_")


def first_month_date(s: Column) -> Column:
    return F.nullif(F.regexp_extract(s, MONTH_DATE, 0), F.lit(""))


def first_loose_date(s: Column) -> Column:
    """The first text such as `January 5, 1990`, even if only the end of the month's name was read (`nuary 5, 1990`, `ber 5, 1990`); null without one."""
    return F.nullif(F.regexp_extract(s, LOOSE_DATE, 0), F.lit(""))


def parse_month_date(s: Column) -> Column:
    """The first date such as `Jan 5, 1990` in a text, or null."""
    m, d, y = (F.regexp_extract(s, MONTH_DATE, i) for i in (1, 2, 3))
    return F.try_to_date(F.concat_ws(" ", F.initcap(F.substring(m, 1, 3)), d, y), "MMM d yyyy")


def world_file_path(path: Column) -> Column:
    ext = F.lower(F.substring_index(path, ".", -1))
    to = F.create_map(*[F.lit(x) for kv in WORLD_FILES.items() for x in kv])
    return F.when(F.element_at(to, ext).isNotNull(), F.concat(F.regexp_replace(path, r"[^.]*$", ""), F.element_at(to, ext)))


def number_in(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "").try_cast("long")


def run_number(s: Column) -> Column:
    """N of a folder `expN`; `exp` alone is 0."""
    return F.when(s == "exp", 0).otherwise(F.regexp_extract(s, "^exp([0-9]+)$", 1).try_cast("int"))


def edit_score(a: Column, b: Column) -> Column:
    """100 for equal texts, 0 for quite different ones, by edit distance."""
    most = F.greatest(F.length(a), F.length(b), F.lit(1))
    return F.round(100 * (1 - F.levenshtein(a, b) / most), 4)


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each character of `a`."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit) | (row - hit)
    return len(a) - bin(row & full).count("1")


def ratio(a: str | None, b: str | None) -> float | None:
    """Indel similarity, 0 to 100."""
    if a is None or b is None:
        return None
    return 100.0 * 2 * common_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial(a: str | None, b: str | None) -> float | None:
    """The best ratio of the shorter text with a stretch of the longer one of its length."""
    if a is None or b is None:
        return None
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    return max(ratio(a, b[max(0, i) : i + len(a)]) for i in range(1 - len(a), len(b)))


@F.pandas_udf(DoubleType())
def fuzzy_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([partial(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def partial_alignment(text: str, key: str) -> tuple[float, int, int]:
    """The best ratio of the key with a stretch of the text of its length or cut off by an end, and where that stretch starts and stops; the first of equal ones. What an end cuts off counts as wrong characters, so that the end of a longer name isn't taken for the key. A text no longer than the key is one stretch, met by the key's best one."""
    if len(text) <= len(key):
        return partial(text, key) or 0.0, 0, len(text)
    best = (0.0, 0, 0)
    for i in range(1 - len(key), len(text)):
        score = 100.0 * common_length(key, text[max(0, i) : i + len(key)]) / len(key)
        if score > best[0]:
            best = (score, max(0, i), min(i + len(key), len(text)))
    return best


def words_sorted(s: str) -> str:
    return " ".join(sorted(s.split()))


def set_ratio(a: str, b: str, score) -> float:
    """The best score among the common words and these with either side's other words."""
    p, q = set(a.split()), set(b.split())
    both = " ".join(sorted(p & q))
    one, two = (" ".join(filter(None, (both, " ".join(sorted(x))))) for x in (p - q, q - p))
    return max(score(both, one), score(both, two), score(one, two)) if both else score(one, two)


def weighted(a: str | None, b: str | None) -> float | None:
    """The default score of fuzzy matching, 0 to 100 in whole numbers: the best of the plain, sorted-word and common-word ratios, or of their partial forms if one text is half as long again; texts are compared in lower case without punctuation."""
    if a is None or b is None:
        return None
    a, b = (re.sub(r"[\W_]", lambda m: "_" if m[0] == "_" else " ", s).lower().strip() for s in (a, b))
    if not a or not b:
        return 0.0
    long = max(len(a), len(b)) / min(len(a), len(b))
    best = ratio(a, b)
    if long < 1.5:
        others = [0.95 * ratio(words_sorted(a), words_sorted(b)), 0.95 * set_ratio(a, b, ratio)]
    else:
        scale = 0.9 if long <= 8 else 0.6
        others = [scale * partial(a, b), 0.95 * scale * partial(words_sorted(a), words_sorted(b)), 0.95 * scale * set_ratio(a, b, partial)]
    return float(round(max(best, *others)))


@F.pandas_udf(DoubleType())
def weighted_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([weighted(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def aligned_name(s: Column, key: str) -> Column:
    """A name as clean_name gives it, even where its key was misread: the key takes the place of the stretch most like it, and seven characters after that stay."""
    t = F.regexp_replace(F.regexp_replace(s, " 8$", "B"), "[^A-Za-z0-9_]", "")
    at = F.instr(t, key)
    t = fix_confusions(F.when(at > 0, F.substring(t, at, F.length(t))).otherwise(t))

    @F.pandas_udf(StringType())
    def rest(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else x[(stop := partial_alignment(x, key)[2]) : stop + 7])

    return keep_letters(F.concat(F.lit(key), rest(t)), 1)
