from pyspark.sql import functions as F

from kinvec.streaming.increments import process_increments


def test_each_file_once(spark, tmp_path):
    source, sink, state = (str(tmp_path / x) for x in ("source", "sink", "state"))
    rows = lambda a, b: spark.range(a, b).withColumn("text", F.concat(F.lit("t"), F.col("id").cast("string")))
    schema = rows(0, 1).schema
    run = lambda: process_increments(spark, source, schema, lambda d: d.withColumn("n", F.length("text")), sink, state)
    rows(0, 10).write.parquet(source)
    run()
    run()
    rows(10, 15).write.mode("append").parquet(source)
    run()
    assert sorted(r.id for r in spark.read.parquet(sink).collect()) == list(range(15))
