"""URL filter: host and path rules, and gradient-boosted trees for the URLs that no rule decides.

The trees learn from URLs that a rule labels (block is 1), both labels having
the same weight in all. Their features are lexical: lengths, depth, digit ratio,
entropy, parameter counts, and statistics of suffixes and parts: the length of
the host's suffix, and how common the path's first part, its ending and the
shape of the URL's tail are among all pages. Which suffix the host has is not a
feature: rules label by it, so trees that see it learn the rules' hosts and
nothing about other URLs. Features, rules, training and scoring are DataFrame
and JVM operations.

How common a part is comes from counts in BUCKETS hash buckets: tasks count
first, so a part that most pages share is a row for each task, the table of
counts is small whatever the corpus, and pages are never shuffled. Rare parts
share a bucket with others.

A null URL, or one without ://, has an empty host and path, matches no rule and
is judged by the trees like any other. Without labels of both kinds there is
nothing to learn: all undecided URLs then get the only label there is, or
allow. Rules that fit equally long are ordered by host and path, so ties have
one result. Repeated rows are judged alike, very long URLs whole; an empty table
gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion.runtime import checkpointed

#: Verdict, host and path; a rule holds for the host and all its subdomains.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: At most so many labelled URLs train the trees, those with the smallest hashes.
MOST_TRAINING_ROWS = 20_000
#: Hash buckets of the counts of URL parts.
BUCKETS = 4096
PARTS = ("first", "ending", "tail")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("n", "host_n", "path_n", "query_n", "depth", "labels", "digits", "host_digits", "hyphens", "parameters", "entropy", "host_entropy", "https", "fragment", "escapes", "suffix_n", "first_share", "ending_share", "tail_share")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path of a URL; both empty without ://."""
    rest = F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest fitting rule, as host and path, and its verdict; null if none fits."""
    rule = verdict = F.lit(None).cast("string")
    for kind, domain, prefix in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1:])):
        fits = ((host == domain) | F.endswith(host, F.lit(f".{domain}"))) & F.startswith(path, F.lit(prefix))
        rule = F.when(fits, F.lit(domain + prefix)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _entropy(text: Column) -> Column:
    n = F.char_length(text)
    bits = F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda acc, c: acc - F.when(c == "", 0.0).otherwise((n - F.char_length(F.replace(text, c, F.lit("")))) / n * F.log2((n - F.char_length(F.replace(text, c, F.lit("")))) / n)))
    return F.when(n > 0, bits).otherwise(0.0)


def _parts(url: Column, path: Column) -> dict[str, Column]:
    """Buckets of the path's first part, of its ending, and of the shape of the URL's last characters."""
    shape = F.regexp_replace(F.regexp_replace(F.regexp_extract(url, r"[^/]{0,12}/?$", 0), "[0-9]+", "0"), "[A-Za-z]+", "a")
    parts = (F.coalesce(F.get(F.split(path, "/"), F.lit(1)), F.lit("")), F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1), shape)
    return {name: F.pmod(F.xxhash64(part), F.lit(BUCKETS)).cast("int") for name, part in zip(PARTS, parts, strict=True)}


def _addresses(pages: DataFrame, url_col: str) -> DataFrame:
    """`row` (a struct of all columns of `pages`), `url`, `host` and `path`."""
    d = pages.select(F.struct("*").alias("row"), F.coalesce(F.col(url_col), F.lit("")).alias("url"))
    host, path = host_and_path(F.col("url"))
    return d.select("row", "url", host.alias("host"), path.alias("path"))


def part_shares(addresses: DataFrame) -> dict[str, DataFrame]:
    """For each part a table (bucket, share) of at most BUCKETS rows; the share is the logarithm of that of all pages."""
    buckets = F.array(*(F.struct(F.lit(name).alias("part"), b.alias("bucket")) for name, b in _parts(F.col("url"), F.col("path")).items()))
    counts = addresses.select(F.inline(buckets)).groupBy("part", "bucket").agg(F.count("*").alias("n")).collect()  # 3 BUCKETS rows at most
    total = sum(r["n"] for r in counts) / len(PARTS)
    return {name: addresses.sparkSession.createDataFrame([(r["bucket"], math.log2((r["n"] + 1) / total)) for r in counts if r["part"] == name], "bucket int, share double") for name in PARTS}


def lexical_features(addresses: DataFrame, shares: dict[str, DataFrame]) -> DataFrame:
    """The columns of `addresses` and the FEATURES."""
    n = F.greatest(F.char_length("url"), F.lit(1))
    count = lambda c, pattern: F.regexp_count(c, F.lit(pattern)).cast("double")
    without = lambda c, kept: F.char_length(F.regexp_replace(c, f"[^{kept}]+", "")).cast("double")
    d = addresses.withColumns({
        "suffix_n": F.char_length(F.substring_index("host", ".", -1)).cast("double"),
        "n": F.char_length("url").cast("double"),
        "host_n": F.char_length("host").cast("double"),
        "path_n": F.char_length("path").cast("double"),
        "query_n": F.char_length(F.regexp_extract("url", r"\?([^#]*)", 1)).cast("double"),
        "depth": count("path", "/[^/]"),
        "labels": count("host", r"[^.]+"),
        "digits": without("url", "0-9") / n,
        "host_digits": without("host", "0-9"),
        "hyphens": without("url", "_-"),
        "parameters": count("url", "[?&][^?&#=]+="),
        "entropy": _entropy(F.col("url")),
        "host_entropy": _entropy(F.col("host")),
        "https": F.startswith("url", F.lit("https:")).cast("double"),
        "fragment": F.contains("url", F.lit("#")).cast("double"),
        "escapes": count("url", "%[0-9A-Fa-f]{2}"),
        **{f"_{name}": bucket for name, bucket in _parts(F.col("url"), F.col("path")).items()},
    })
    for name, table in shares.items():
        side = table.select(F.col("bucket").alias(f"_{name}"), F.col("share").alias(f"{name}_share"))
        d = d.join(F.broadcast(side), f"_{name}", "left").drop(f"_{name}")
    return d


def filter_urls(pages: DataFrame, url_col: str = "url", rules: tuple = RULES, most_rows: int = MOST_TRAINING_ROWS, trees: int = 20, depth: int = 4, held_out: Column | None = None) -> DataFrame:
    """`row`, `host`, `path`, `rule`, `verdict` and `score`, the trees' probability of block (null without a model).

    Rows with `held_out`, an expression over `url`, never train.
    """
    d = _addresses(pages, url_col)
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    d = d.withColumns({"rule": rule, "_given": verdict})
    labelled = d.where(F.col("_given").isNotNull() if held_out is None else F.col("_given").isNotNull() & ~held_out)
    # the sample is chosen by its URLs; features are made for its rows only
    sample = checkpointed(labelled.select("url", "host", "path", (F.col("_given") == "block").cast("double").alias("label")).orderBy(F.xxhash64("url"), "url").limit(most_rows))
    n_rows = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(n_rows) == 2:
        shares = part_shares(d)
        assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="_features", handleInvalid="keep")
        model = GBTClassifier(featuresCol="_features", weightCol="_weight", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=7, checkpointInterval=-1, cacheNodeIds=False)
        weight = F.when(F.col("label") == 1, 0.5 / n_rows[1.0]).otherwise(0.5 / n_rows[0.0]) * sum(n_rows.values())
        fitted = model.fit(assembler.transform(lexical_features(sample, shares)).select("label", weight.alias("_weight"), "_features"))
        fitted.setPredictionCol("_block").setProbabilityCol("_probability").setRawPredictionCol("")
        d = fitted.transform(assembler.transform(lexical_features(d, shares))).withColumn("score", vector_to_array("_probability")[1])
        judged = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    else:
        d = d.withColumn("score", F.lit(None).cast("double"))
        judged = F.lit("block" if set(n_rows) == {1.0} else "allow")
    return d.select("row", "host", "path", "rule", F.coalesce("_given", judged).alias("verdict"), "score")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
    return judged.select(F.col("row.page_id").alias("page_id"), "host", "path", "rule", "verdict", "score")
