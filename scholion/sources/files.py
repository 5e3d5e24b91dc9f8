"""Readers and writers of the file formats of bibliographic dumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def split_tsv(lines: DataFrame, schema: T.StructType, value: str = "value") -> DataFrame:
    """Rows of tab-separated lines; blank lines and lines of another arity are dropped, bad values are null."""
    parts = F.split(F.rtrim(F.regexp_replace(F.col(value), r"[\r\n]+$", "")), "\t", -1)
    d = lines.select(parts.alias("_p")).where((F.size("_p") == len(schema.fields)) & (F.array_join("_p", "") != ""))
    return d.select(*(F.get("_p", F.lit(k)).try_cast(f.dataType).alias(f.name) for k, f in enumerate(schema.fields)))


def read_tsv(spark: SparkSession, path: str, schema: T.StructType, key: str | None = None) -> DataFrame:
    """A TSV file without header; with `key`, for each of its values the smallest row."""
    d = split_tsv(spark.read.text(path), schema)
    return d.groupBy(key).agg(F.min(F.struct(*d.columns)).alias("_r")).select("_r.*") if key else d


def split_tagged(records: DataFrame, tags: dict[str, str], repeated: tuple[str, ...] = (), value: str = "value") -> DataFrame:
    """Columns of records whose lines begin with tags; a tag in `repeated` gives an array."""
    lines = F.split(F.col(value), r"\r?\n")

    def column(tag: str, name: str) -> Column:
        own = F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit(tag))), lambda x: F.trim(F.substring(x, len(tag) + 1, 1 << 20)))
        return (own if name in repeated else F.nullif(F.get(own, F.lit(0)), F.lit(""))).alias(name)

    return records.where(F.trim(value) != "").select(*(column(t, n) for t, n in tags.items()))


#: Tags of paper and author records.
PAPER_TAGS = {"#index": "id", "#*": "title", "#t": "year", "#c": "venue", "#!": "abstract", "#%": "cited"}
AUTHOR_TAGS = {"#index": "id", "#n": "name", "#a": "affil", "#pc": "papers", "#cn": "citations", "#hi": "h_index", "#t": "terms"}


def read_tagged(spark: SparkSession, path: str, tags: dict[str, str], repeated: tuple[str, ...] = ()) -> DataFrame:
    """Records of files; each begins with a line of the first tag, so the kinds of line ends and blank lines do not matter."""
    first = next(iter(tags))
    d = spark.read.option("lineSep", f"\n{first} ").text(path)
    # what the separator took away is given back, but to the head of a file
    return split_tagged(d.select(F.when(F.startswith(F.ltrim("value"), F.lit(first)), F.col("value")).otherwise(F.concat(F.lit(f"{first} "), F.col("value"))).alias("value")), tags, repeated)


def split_pairs(lines: DataFrame, names: tuple[str, ...], skip_first_character: bool = False, value: str = "value") -> DataFrame:
    """Columns of whitespace-separated lines, as strings; shorter lines are dropped."""
    text = F.substring(F.col(value), 2, 1 << 20) if skip_first_character else F.col(value)
    parts = F.split(F.trim(text), r"\s+")
    return lines.select(parts.alias("_p")).where(F.size("_p") >= len(names)).select(*(F.get("_p", F.lit(k)).alias(n) for k, n in enumerate(names)))


def read_homepages(spark: SparkSession, path: str) -> DataFrame:
    """key, name, other_names, affil of the person records of a bibliography in XML; other records are ignored."""
    schema = "_key string, author array<string>, note array<struct<_VALUE string, _type string>>, url array<string>"
    d = spark.read.format("xml").option("rowTag", "www").schema(schema).load(path)
    names = F.transform("author", lambda a: F.regexp_replace(a, r" \d+$", ""))
    notes = F.transform(F.filter("note", lambda n: n["_type"] == "affiliation"), lambda n: n["_VALUE"])
    return d.where("_key LIKE 'homepages/%'").select(F.col("_key").alias("key"), F.get(names, F.lit(0)).alias("name"), F.array_join(F.slice(names, F.lit(2), F.greatest(F.size(names) - 1, F.lit(0))), "/").alias("other_names"), F.get(notes, F.lit(0)).alias("affil"), F.get("url", F.lit(0)).alias("url"))


def homepage_of(xml: Column) -> Column:
    """name, affil of one record as a string, by XPath."""
    return F.struct(F.regexp_replace(F.xpath_string(xml, F.lit("/www/author[1]")), r" \d+$", "").alias("name"), F.xpath_string(xml, F.lit("/www/note[@type='affiliation']")).alias("affil"))


def read_result_lists(spark: SparkSession, path: str) -> DataFrame:
    """query, title of files whose first line is a query and whose others are titles; titles that differ in case are one."""
    d = spark.read.text(path, wholetext=True).select(F.split("value", r"\r?\n").alias("_l"))
    rows = d.select(F.get("_l", F.lit(0)).alias("query"), F.posexplode(F.slice("_l", F.lit(2), F.greatest(F.size("_l") - 1, F.lit(0)))).alias("position", "title")).where(F.trim("title") != "")
    return rows.groupBy("query", F.lower("title").alias("_t")).agg(F.min_by("title", "position").alias("title"), F.min("position").alias("position")).drop("_t")


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """row, column, value of a grid of numbers, a line a row, each from 0; several files follow each other by name.

    Lines are numbered by the splits of the files, so a grid need not fit a task.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i")).where(F.trim("value") != "")
    splits = lines.groupBy("_f", "_b").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    bases = splits.select("_f", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    nth = F.row_number().over(Window.partitionBy("_f", "_b").orderBy("_i")) - 1
    numbered = lines.withColumn("_nth", nth).join(F.broadcast(bases), ["_f", "_b"])
    return numbered.select((F.col("_base") + F.col("_nth")).alias("row"), F.posexplode(F.split(F.trim("value"), r"\s+")).alias("column", "value")).withColumn("value", F.col("value").cast("double"))


def create_table(spark: SparkSession, name: str, schema: T.StructType, drop: bool = False) -> None:
    """Create a table unless it is there; with `drop`, an old one goes first."""
    if drop:
        spark.sql(f"DROP TABLE IF EXISTS {name} PURGE")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema.toDDL()}) USING parquet")


def insert(rows: DataFrame, name: str) -> None:
    rows.write.insertInto(name)


def read_ranking(spark: SparkSession, path: str) -> DataFrame:
    """conf_id, affil_id, score, as `write_ranking` has them."""
    return spark.read.option("sep", "\t").schema("conf_id string, affil_id string, score double").csv(path)


def write_tsv(df: DataFrame, path: str, header: bool = False) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", header).csv(path)


def write_ranking(scores: DataFrame, path: str) -> None:
    """conf_id, affil_id, score."""
    write_tsv(scores.select("conf_id", "affil_id", "score"), path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def write_bulk_csv(nodes: DataFrame, edges: DataFrame, path: str, kind: str) -> None:
    """Node and edge files with the headers of a graph database's bulk loader."""
    nodes.select(F.col("node").alias(f"entity_id:ID({kind})")).write.mode("overwrite").option("header", True).csv(f"{path}/nodes")
    edges.select(F.col("src").alias(f":START_ID({kind})"), F.col("dst").alias(f":END_ID({kind})"), F.col("weight").alias("weight:float")).write.mode("overwrite").option("header", True).csv(f"{path}/edges")


def write_letor(df: DataFrame, path: str, target: str, query: str, features: list[str]) -> None:
    """`target qid:q 1:v 2:v`, the target being 10 times the score, rounded."""
    line = F.concat_ws(" ", F.round(10 * F.col(target)).cast("long").cast("string"), F.concat(F.lit("qid:"), F.col(query)), *(F.concat(F.lit(f"{k}:"), F.col(f)) for k, f in enumerate(features, 1)))
    df.select(line.alias("value")).write.mode("overwrite").text(path)
