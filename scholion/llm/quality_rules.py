"""Line-first quality rules, in DataFrame expressions only.

Every line is judged by itself; lines that fail are removed, and a document
that loses more than `most_lost` of its words goes. Base rules on the whole
text come first. All of it is a projection: no shuffle, no state, one row in
and one row out.

A null text has no words, lines or symbols, so it fails the base rules, as do
empty texts. Repeated rows are judged alike. An empty table gives an empty
result, other columns do not matter. Very long texts are judged whole, the
windows of one being sorted in memory. Sentences may end with the marks of any
script, and those of Thai and Lao with none. Words are runs of characters other
than space, tab, line feed, vertical tab, form feed and carriage return.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MOST_LOST = 0.5
#: Symbols may be this share of a line's non-space characters.
MAX_SYMBOLS = 0.08
#: Capitals may be this share of a line's A-Z letters, in lines of at least MIN_SHOUT letters.
MAX_CAPITALS = 0.7
MIN_SHOUT = 12
#: Doubled marks, like !!, may follow this share of a line's words.
MAX_DOUBLED = 0.2
#: A navigation line has at most so many words.
MAX_NAVIGATION_WORDS = 12
#: Bits of a window's place beside its hash.
PLACE_BITS = 24
SYMBOLS = "#*$%&|<>"
NAVIGATION = r"(?i)\b(skip to (main )?content|main menu|toggle navigation|site map|log ?in|log ?out|sign ?up|sign ?in|next page|previous page|back to top|read more|click here|breadcrumb)\b"
BOILERPLATE = r"(?i)\b(all rights reserved|terms of (use|service)|privacy policy|cookie policy|accept (all )?cookies|enable javascript|copyright \d{4}|subscribe to our newsletter|powered by)\b"
#: Marks that end a sentence or clause in the scripts of Unicode, as code points.
STOP_MARKS = """
0021 002E 003A 003B 003F 037E 0589 061B 061D 061E 061F 06D4 0700 0701 0702 07F9 0837 0839 083D 083E
0964 0965 0E2F 0E5A 0F08 0F0D 0F0E 0F11 104A 104B 1361 1362 1364 1365 1366 1367 1368 166E 1735 1736
17D4 17D5 17D6 1803 1809 1944 1945 1AA8 1AA9 1AAA 1AAB 1B5A 1B5B 1B5E 1B5F 1C3B 1C3C 1C7E 1C7F 2026
203C 203D 2047 2048 2049 2E2E 3002 A4FF A60E A60F A6F3 A6F7 A876 A877 A8CE A8CF A92F A9C8 A9C9 AA5D
AA5E AA5F AAF0 AAF1 ABEB FE52 FE54 FE55 FE56 FE57 FF01 FF0E FF1A FF1B FF1F FF61
"""
#: Thai and Lao prose has no such marks; a line with their letters has a stop.
UNMARKED = r"\u0E01-\u0E2E\u0E81-\u0EAE"
STOPS = "[" + "".join(f"\\u{m}" for m in STOP_MARKS.split()) + UNMARKED + "]"
DOUBLED = r"[!?*#$%&]{2,}"
CAPITALS_IN_A_ROW = "[A-Z][^A-Za-z]*[A-Z]"
STOPS_SQL = re.sub(r"\\u([0-9A-F]{4})", r"\\x{\1}", STOPS)


def _flat(text: Column) -> Column:
    """Spaces for tab, vertical tab, form feed and carriage return; a search that finds none copies nothing."""
    for c in "\t\u000b\f\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def _words(flat: Column) -> Column:
    return F.array_remove(F.split(flat, " "), "")


def _count(text: Column, class_: str) -> Column:
    """Characters of the class, such as A-Z; those of other characters are removed in runs."""
    return F.char_length(F.regexp_replace(text, f"[^{class_}]+", ""))


def _fails(line: Column, n: Column, flags: Column) -> Column:
    """Whether a line of n words, one or more, fails a rule.

    `flags` of the whole text spare most lines the count of symbols, capitals
    and doubled marks. Where capitals are over half of the letters, two of them
    follow each other without another letter between.
    """
    symbols, letters = _count(line, SYMBOLS), _count(line, "A-Za-z")
    many_symbols = (symbols >= 3) & (symbols > F.char_length(F.regexp_replace(line, r"[\x20\x09-\x0D]+", "")) * MAX_SYMBOLS)
    shouts = (letters >= MIN_SHOUT) & (_count(line, "A-Z") > letters * MAX_CAPITALS)
    doubled = F.regexp_count(line, F.lit(DOUBLED))
    return (
        ((n >= 5) & ~line.rlike(STOPS))
        | ((n <= MAX_NAVIGATION_WORDS) & line.rlike(NAVIGATION))
        | ((n <= 2 * MAX_NAVIGATION_WORDS) & line.rlike(BOILERPLATE))
        | (flags["symbols"] & many_symbols)
        | (flags["capitals"] & line.rlike(CAPITALS_IN_A_ROW) & shouts)
        | (flags["doubled"] & (doubled >= 2) & (doubled > n * MAX_DOUBLED))
    )


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that later expressions read and never compute again, not even inside lambdas."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _neighbours(ordered: str, key: Callable[[Column], Column]) -> Column:
    """The entries of a sorted array whose key one of the next entries has too."""
    return F.filter(ordered, lambda x, i: F.coalesce(key(x) == key(F.get(ordered, i + 1)), F.lit(False)) | F.when(i > 0, key(x) == key(F.get(ordered, i - 1))).otherwise(False))


def _repeated_windows(d: DataFrame) -> DataFrame:
    """`repeated`, the places of the windows that stand more than once, in place of their hashes `windows`.

    Most texts repeat no window, which a set of the hashes tells. In others
    equal windows are neighbours once sorted. A word of 64 bits with the low
    bits of the hash over the place sorts fastest; should two windows share
    those bits, or the places need more, hash and place are sorted in full.
    """
    n, place, none = F.size("windows"), (1 << PLACE_BITS) - 1, F.array().cast("array<bigint>")
    d = _once(d, "n_distinct", F.size(F.array_distinct("windows")))
    some = F.col("n_distinct") < n
    short = F.transform("windows", lambda h, i: F.shiftleft(h, PLACE_BITS).bitwiseOR(i.cast("long")))
    d = _once(d, "packed", F.when(some & (n <= place), F.sort_array(short)).otherwise(none))
    key = lambda x: F.shiftright(x, PLACE_BITS)
    n_keys = F.size(F.filter("packed", lambda x, i: F.coalesce(key(x) != key(F.get("packed", i + 1)), F.lit(True))))
    d = _once(d, "unclear", some & (n_keys != F.col("n_distinct")))
    full = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i"))))
    d = _once(d, "full", F.when(F.col("unclear"), full).otherwise(F.array().cast("array<struct<h:bigint,i:bigint>>")))
    repeated = F.when(
        F.col("unclear"), F.transform(_neighbours("full", lambda x: x["h"]), lambda x: x["i"])
    ).otherwise(F.transform(_neighbours("packed", key), lambda x: x.bitwiseAND(F.lit(place))))
    return _once(d.drop("windows", "n_distinct"), "repeated", repeated).drop("packed", "unclear", "full")


def quality_columns(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`row` (a struct of all columns of `docs`), the base counts, the lines' verdicts and `kept`."""
    d = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = _once(d, "words", _words(F.replace(_flat(F.col("text")), F.lit("\n"), F.lit(" "))))
    n = F.size("words")
    squeezed = F.array_join("words", "")
    windows = F.transform(F.slice("words", F.lit(1), F.greatest(n - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))
    d = d.select(
        "row",
        "text",
        n.cast("long").alias("n_words"),
        F.char_length(squeezed).cast("long").alias("word_chars"),
        _count(squeezed, SYMBOLS).cast("long").alias("n_symbols"),
        F.explode(F.array(windows)).alias("windows"),
    )
    d = _repeated_windows(d)
    covered = F.array_union(F.array_union("repeated", F.transform("repeated", lambda i: i + 1)), F.transform("repeated", lambda i: i + 2))
    d = d.withColumn("n_repeat_words", F.size(covered).cast("long")).drop("repeated")
    d = _once(d, "flags", F.struct((F.col("n_symbols") >= 3).alias("symbols"), F.col("text").rlike(CAPITALS_IN_A_ROW).alias("capitals"), F.col("text").rlike(DOUBLED).alias("doubled")))
    counted = F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("line"), F.size(_words(_flat(x))).alias("n")))
    judged = F.transform(counted, lambda x: F.struct(x["line"].alias("line"), x["n"].alias("n"), ((x["n"] > 0) & _fails(x["line"], x["n"], F.col("flags"))).alias("fails")))
    d = _once(d, "lines", judged).drop("flags")
    real = F.transform(F.filter("lines", lambda x: x["n"] > 0), lambda x: x["line"])
    lost = F.aggregate("lines", F.lit(0).cast("long"), lambda acc, x: acc + F.when(x["fails"], x["n"]).otherwise(0))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    d = _once(d, "words_lost", lost)
    return d.select(
        "row",
        "lines",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size(real) - F.size(F.array_distinct(real))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        base.alias("base_failed"),
        "words_lost",
        (~base & (F.col("words_lost") <= F.col("n_words") * MOST_LOST)).alias("kept"),
    )


def apply_quality_rules(docs: DataFrame, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """The kept documents with failing lines removed, in the columns of `docs`; `size_col`, if there is one, follows."""
    judged = quality_columns(docs, text_col).where("kept")
    names = docs.columns
    text = F.array_join(F.transform(F.filter("lines", lambda x: ~x["fails"]), lambda x: x["line"]), "\n")
    d = judged.withColumn("_text", F.when(F.col("words_lost") > 0, text).otherwise(F.col("row")[text_col]))
    new = {text_col: F.col("_text"), size_col: F.when(F.col("words_lost") > 0, F.char_length("_text").cast("long")).otherwise(F.col("row")[size_col]) if size_col in names else None}
    return d.select(*(new.get(c, F.col("row")[c]).alias(c) for c in names))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality_columns(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return d.select(F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "words_lost", "kept")


def _sql_count(what: str, pattern: str) -> str:
    return f"len(regexp_extract_all({what}, '{pattern}'))"


_NAV_SQL, _BOILER_SQL = NAVIGATION.replace("'", "''"), BOILERPLATE.replace("'", "''")
_SPACE_SQL = r"[\x20\x09-\x0D]+"
ORACLE_SQL = rf"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(text, '{_SPACE_SQL}'), lambda x: x <> '') AS words FROM docs
), windows AS (
  SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT r, words, unnest(range(1, greatest(len(words) - 1, 1))) AS i FROM w)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM windows) WHERE n > 1
), repeats AS (
  SELECT r, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS t(k) GROUP BY r
), lines AS (
  SELECT r, line, len(list_filter(regexp_split_to_array(line, '{_SPACE_SQL}'), lambda x: x <> '')) AS n,
    regexp_replace(line, '{_SPACE_SQL}', '', 'g') AS squeezed
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs)
), counted AS (
  SELECT r, line, n, length(squeezed) AS c, {_sql_count("squeezed", "[#*$%&|<>]")} AS symbols,
    {_sql_count("line", "[A-Za-z]")} AS letters, {_sql_count("line", "[A-Z]")} AS capitals,
    {_sql_count("line", DOUBLED)} AS doubled
  FROM lines WHERE n > 0
), judged AS (
  SELECT r, line, n, ((symbols >= 3 AND symbols > c * {MAX_SYMBOLS}) OR (letters >= {MIN_SHOUT} AND capitals > letters * {MAX_CAPITALS})
    OR (doubled >= 2 AND doubled > n * {MAX_DOUBLED}) OR (n >= 5 AND NOT regexp_matches(line, '{STOPS_SQL}'))
    OR (n <= {MAX_NAVIGATION_WORDS} AND regexp_matches(line, '{_NAV_SQL}'))
    OR (n <= {2 * MAX_NAVIGATION_WORDS} AND regexp_matches(line, '{_BOILER_SQL}'))) AS fails
  FROM counted
), by_doc AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines, coalesce(sum(n) FILTER (fails), 0) AS words_lost FROM judged GROUP BY r
), base AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '{_SPACE_SQL}', '', 'g'))::BIGINT AS word_chars,
    {_sql_count("text", "[#*$%&|<>]")}::BIGINT AS n_symbols, coalesce(b.n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(p.n, 0)::BIGINT AS n_repeat_words, coalesce(b.words_lost, 0)::BIGINT AS words_lost
  FROM w LEFT JOIN repeats p USING (r) LEFT JOIN by_doc b USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed, words_lost,
  (NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND words_lost <= n_words * {MOST_LOST}) AS kept
FROM base
"""
