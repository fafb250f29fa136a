"""Reading and publishing tables: text tables, condition partitions with markers, manifests, logs."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_text_table(spark: SparkSession, path: str, columns: list[str], aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """A CSV as strings, blanks as '' and not null, a byte-order mark cut off, required columns checked.

    aliases: names that may stand for a required column; the first present wins.
    """
    raw = spark.read.option("header", True).option("encoding", "UTF-8").option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    picked = {c: next((x for x in [c, *(aliases or {}).get(c, [])] if x in raw.columns), None) for c in columns}
    if missing := [c for c, x in picked.items() if x is None]:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return raw.select(*[F.coalesce(F.col(f"`{x}`"), F.lit("")).alias(c) for c, x in picked.items()])


def write_conditions(df: DataFrame, path: str, by: tuple[str, ...] = ("model", "channel")) -> None:
    """Publishes only the partitions that df has; others stay as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def pending_conditions(expected: DataFrame, done: DataFrame, by: tuple[str, ...] = ("model", "channel")) -> DataFrame:
    return expected.select(*by).join(done.select(*by).distinct(), list(by), "left_anti")


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows, and the sum and XOR of 60-bit hashes of the columns, to freeze an input in any order."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns])
    h = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("xor"))


def refuse_drift(df: DataFrame, columns: list[str], manifest: dict | None) -> dict:
    """The fingerprint; an error if a manifest of an earlier run says otherwise."""
    now = fingerprint(df, columns).first().asDict()
    if manifest is not None and manifest != now:
        raise ValueError(f"input changed: {json.dumps(manifest)} before, {json.dumps(now)} now")
    return now


def write_manifest(spark: SparkSession, path: str, content: dict) -> None:
    """One JSON document through Spark's committer, so it is whole or absent."""
    spark.createDataFrame([(json.dumps(content, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first().value)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


LOG = T.StructType([
    T.StructField("batch_id", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("attempts", T.ArrayType(T.StructType([T.StructField("attempt", T.LongType()), T.StructField("status", T.StringType()), T.StructField("elapsed_seconds", T.DoubleType())]))),
])


def log_stats(spark: SparkSession, path: str) -> DataFrame:
    """batches, failures, attempts and retries of a JSON-lines log; malformed lines are skipped."""
    log = spark.read.schema(LOG).option("mode", "DROPMALFORMED").json(path).where("batch_id is not null")
    n = F.size(F.coalesce("attempts", F.array().cast(LOG["attempts"].dataType)))
    return log.agg(F.count("*").alias("batches"), F.count_if(F.col("status") != "ok").alias("failures"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("attempts"), F.count_if(n > 1).alias("retried"))


def encode_texts(df: DataFrame, encoder, text: str = "text", key: str = "id", prefix: str = "") -> DataFrame:
    """key and v for each row: distinct texts are encoded once, in Arrow batches, and joined back.

    encoder() is called once a task and returns a function from texts to lists of floats.
    """
    import pandas as pd

    rows = df.select(key, F.concat(F.lit(prefix), F.coalesce(F.col(text), F.lit(""))).alias("_t")).withColumn("_h", F.sha2("_t", 256))

    def run(batches):
        encode = encoder()
        for b in batches:
            yield pd.DataFrame({"_h": b["_h"], "v": [list(map(float, v)) for v in encode(b["_t"].tolist())]})

    once = rows.groupBy("_h").agg(F.any_value("_t").alias("_t"))
    return rows.select(key, "_h").join(once.mapInPandas(run, "_h string, v array<double>"), "_h").select(key, "v")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which driver and executors share.

    The cluster names it in spark.checkpoint.dir. Only on one machine, where that is unset, a temporary
    folder is taken; on a cluster it would scatter tables over local disks, so there it is an error.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="kinvec-"))
    return sc._jsc.sc().getCheckpointDir().get()


def translated(df: DataFrame, client, text: str = "text", key: str = "id", batch: int = 25, attempts: int = 5, wait: float = 1.0) -> DataFrame:
    """key, translation, attempts, error of each row: distinct texts go to an outside service in batches.

    client() is called once a task and returns a function from a list of texts to a list of translations.
    A batch that fails is tried again after twice the wait each time; when all attempts fail its rows get
    a null translation and the last error. Blank texts are not sent. No client is shipped.
    """
    import time

    import pandas as pd

    rows = df.select(key, F.coalesce(F.col(text), F.lit("")).alias("_t")).withColumn("_h", F.sha2("_t", 256))

    def run(frames):
        send = client()
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                for n in range(1, attempts + 1):
                    try:
                        got, error = list(send(part["_t"].tolist())), None
                        if len(got) != len(part):
                            raise ValueError(f"{len(got)} translations of {len(part)} texts")
                        break
                    except Exception as e:  # the service's own errors are many
                        got, error = [None] * len(part), str(e)
                        if n < attempts:
                            time.sleep(wait * 2 ** (n - 1))
                yield pd.DataFrame({"_h": part["_h"], "translation": got, "attempts": n, "error": error})

    once = rows.where("trim(_t) <> ''").groupBy("_h").agg(F.any_value("_t").alias("_t"))
    sent = once.mapInPandas(run, "_h string, translation string, attempts int, error string")
    return rows.select(key, "_h").join(sent, "_h", "left").select(key, "translation", F.coalesce("attempts", F.lit(0)).alias("attempts"), "error")


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/stored/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
