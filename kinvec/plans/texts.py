"""Queries over texts: predicates, quality counters, dedup before encoding, increments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.testdata import table
from .common import query


@query(
    "SELECT doc_id, sha256(text) AS text_sha256, strlen(text) AS n_bytes, length(trim(text, chr(32) || chr(9) || chr(10) || chr(13) || chr(160) || chr(12288))) <= 1 AS is_short, "
    "length(text) - length(replace(text, '.', '')) > 1 AS several, regexp_matches(text, '[\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}\\x{20000}-\\x{323af}]') AS cjk, "
    "regexp_matches(text, '^[^\\p{L}\\p{N}]+$') AS punctuation, starts_with(source, 'src1') OR starts_with(source, 'src2') AS listed, "
    "CASE WHEN length(text) > greatest(300, 8 * length(source)) THEN 'long' END AS suspicious, '[' || lang || '] ' || source AS prefixed FROM documents"
)
def text_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id", F.sha2("text", 256).alias("text_sha256"), F.octet_length("text").cast("long").alias("n_bytes"), (F.length(T.strip("text")) <= 1).alias("is_short"), T.several_sentences("text").alias("several"),
        T.has_cjk("text").alias("cjk"), T.only_punctuation("text").alias("punctuation"), (F.col("source").startswith("src1") | F.col("source").startswith("src2")).alias("listed"),
        F.when(T.suspicious_length("text", "source") == "long", "long").alias("suspicious"), F.concat(F.lit("["), F.col("lang"), F.lit("] "), F.col("source")).alias("prefixed"),
    )


@query(
    "WITH x(k, s) AS (VALUES (1, '⿰女子'), (2, ' ⿱艹早'), (3, '好'), (4, ''), (5, NULL), (6, '⿻十十'), (7, chr(9) || '⿴囗玉'), (8, '　⿸广木'), (9, '⿺辶文'), (10, '⿹勹口'), (11, '⿷匚甲'), (12, '⿶凵㐅'), (13, '⿵門口'), (14, '⿲木木木'), (15, '⿳亠口小')), y(k, layout) AS (VALUES (1, 'left-right'), (2, 'top-bottom'), (3, 'non-IDS'), (4, 'non-IDS'), (5, 'non-IDS'), (6, 'overlay'), (7, 'full-surround'), (8, 'surround-upper-left'), (9, 'surround-lower-left'), (10, 'surround-upper-right'), (11, 'surround-from-left'), (12, 'surround-from-below'), (13, 'surround-from-above'), (14, 'left-middle-right'), (15, 'top-middle-bottom')) "
    "SELECT CAST(k AS INTEGER) AS k, layout, regexp_matches(coalesce(s, ''), '[\\x{4e00}-\\x{9fff}]') AS cjk FROM x JOIN y USING (k)"
)
def layout_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, "⿰女子"), (2, " ⿱艹早"), (3, "好"), (4, ""), (5, None), (6, "⿻十十"), (7, "\t⿴囗玉"), (8, "　⿸广木"), (9, "⿺辶文"), (10, "⿹勹口"), (11, "⿷匚甲"), (12, "⿶凵㐅"), (13, "⿵門口"), (14, "⿲木木木"), (15, "⿳亠口小")], "k int, s string")
    return rows.select("k", T.layout("s").alias("layout"), T.has_cjk("s").alias("cjk"))


@query(
    "WITH d AS (SELECT *, count(*) OVER (PARTITION BY text) AS c FROM documents) SELECT lang, count(*) AS n, count(*) FILTER (WHERE trim(text) = '') AS blank, count(*) FILTER (WHERE c > 1) AS duplicated, "
    "count(DISTINCT text) AS distinct_texts, count(*) FILTER (WHERE length(text) <> n_chars) AS mismatched, round(100.0 * count(*) FILTER (WHERE c > 1) / count(*), 2) AS duplicated_pct FROM d GROUP BY lang"
)
def text_quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters by language; duplicates from counts of hashes, so no window holds all copies of a text."""
    d = table(spark, sf_dir, "documents").withColumn("h", F.sha2("text", 256))
    copies = d.groupBy("h").agg(F.count("*").alias("c")).where("c > 1")
    d = d.join(copies, "h", "left")
    twice = F.col("c").isNotNull()
    out = d.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(T.strip("text") == "").alias("blank"), F.count_if(twice).alias("duplicated"), F.countDistinct("h").alias("distinct_texts"), F.count_if(F.length("text") != F.col("n_chars")).alias("mismatched"))
    return out.withColumn("duplicated_pct", T.percent("duplicated", "n"))


@query("SELECT coalesce(sum(c), 0)::BIGINT AS n_duplicated FROM (SELECT count(*) AS c FROM conversations WHERE trim(text) <> '' GROUP BY text HAVING count(*) > 1)")
def duplicated_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.in_duplicates(table(spark, sf_dir, "conversations"), "text")


@query("SELECT d.doc_id, length(d.text) AS encoded FROM documents d")
def encode_distinct_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct text is encoded once (here: its length) and the code is joined back."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2("text", 256).alias("h"))
    codes = d.groupBy("h").agg(F.any_value("text").alias("t")).select("h", F.length("t").cast("long").alias("encoded"))
    return d.select("doc_id", "h").join(codes, "h").select("doc_id", "encoded")


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def pending_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the input that the finished table lacks."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "lang")


@query("SELECT doc_id, quality, toxic FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY quality, toxic) AS k FROM labels) WHERE k = 1 AND doc_id IN (SELECT doc_id FROM documents WHERE lang IN ('en', 'fr'))")
def audited_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First row of each key, if an allow-list has the key."""
    allowed = table(spark, sf_dir, "documents").where(F.col("lang").isin("en", "fr"))
    first = Window.partitionBy("doc_id").orderBy("quality", "toxic")
    return table(spark, sf_dir, "labels").withColumn("k", F.row_number().over(first)).where("k = 1").join(allowed, "doc_id", "left_semi").select("doc_id", "quality", "toxic")


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'right_only' WHEN l.doc_id IS NULL THEN 'left_only' ELSE 'both' END AS side, coalesce(l.quality, 0) AS quality FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id")
def outer_join_indicator(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit(True).alias("_l"))
    r = table(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(True).alias("_r"))
    side = F.when(F.col("_l").isNull(), "right_only").when(F.col("_r").isNull(), "left_only").otherwise("both")
    return d.join(r, "doc_id", "full_outer").select("doc_id", side.alias("side"), F.coalesce("quality", F.lit(0)).alias("quality"))


@query("SELECT source, CASE WHEN ends_with(source, '0') THEN left(source, length(source) - 1) ELSE source END AS channel, count(*) AS n FROM documents GROUP BY 1")
def channel_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names without the suffix that marks a variant."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")).select("source", T.without_suffix("source", "0").alias("channel"), "n")


@query("WITH s AS (SELECT 7 AS seed, family FROM (VALUES ('a'), ('b'), ('ü')) t(family)) SELECT family, substr(sha256('7|' || family), 1, 16) AS seed_hex, CASE family WHEN 'a' THEN true WHEN 'b' THEN false END AS flag FROM s")
def derived_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("a", " TRUE"), ("b", "false"), ("ü", "yes")], "family string, said string")
    seed = T.derived_seed(F.lit("7"), F.col("family"))
    return rows.select("family", F.lpad(F.lower(F.conv(seed.cast("string"), 10, 16)), 16, "0").alias("seed_hex"), T.truth("said").alias("flag"))
