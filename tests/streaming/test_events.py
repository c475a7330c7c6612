from pyspark.sql import functions as F

from quillstone.streaming.events import carried_state, judge_stream, sessions

SCHEMA = "user string, ts timestamp, n int, v string"


def write(spark, path, rows):
    spark.createDataFrame(rows, "user string, ts string, n int, v string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(path)


def test_streams(spark, tmp_path):
    path = f"{tmp_path}/in"
    write(spark, path, [("a", "2024-01-01 10:00:00", 1, "x"), ("a", "2024-01-01 10:10:00", 2, None), ("b", "2024-01-01 10:00:00", 1, None)])
    judge = lambda rows: rows.select("user", "n", F.upper("v").alias("v"))
    for _ in range(2):
        judge_stream(spark.readStream.schema(SCHEMA).parquet(path), judge, f"{tmp_path}/out", ["user", "n"], f"{tmp_path}/ck1").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3

    q = carried_state(spark.readStream.schema(SCHEMA).parquet(path), "user", "n", "v").writeStream.format("memory").queryName("carried").outputMode("append").start()
    q.processAllAvailable()
    write(spark, path, [("a", "2024-01-01 15:00:00", 3, None), ("b", "2024-01-01 15:00:00", 2, "y")])
    q.processAllAvailable()
    q.stop()
    assert {(r.user, r.n): r.state for r in spark.table("carried").collect()} == {("a", 1): "x", ("a", 2): "x", ("b", 1): None, ("a", 3): "x", ("b", 2): "y"}

    q = sessions(spark.readStream.schema(SCHEMA).parquet(path), "user", "ts").writeStream.format("memory").queryName("sessions").outputMode("append").start()
    q.processAllAvailable()
    write(spark, path, [("z", "2024-01-02 15:00:00", 9, None)])
    q.processAllAvailable()
    q.stop()
    assert sorted((r.user, r.n) for r in spark.table("sessions").collect()) == [("a", 1), ("a", 2), ("b", 1), ("b", 1)]
