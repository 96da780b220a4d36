from pyspark.sql import functions as F

from pagemill.operators import ops
from pagemill.streaming import jobs


def run(spark, stream, name, mode="append"):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


def test_lockouts_in_order(spark, tmp_path):
    rows = [(i, i // 20, f"2024-01-0{1 + (i % 20) // 5} 0{i % 5}:00:00", i % 7 == 0) for i in range(100)]
    df = spark.createDataFrame(rows, "n int, user_id bigint, t string, ok boolean").withColumn("ts", F.to_timestamp("t"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = {(r["user_id"], str(r["locked_at"])) for r in run(spark, jobs.lockouts(stream), "locks").collect()}
    want = {(r["user_id"], str(r["locked_at"])) for r in ops.lockouts(df, key="user_id", at="ts", ok="ok").collect()}
    assert got == want and want


def test_change_status_keeps_state(spark, tmp_path):
    schema = "page_id bigint, url string, content string, crawled_at string"
    for k, rows in enumerate(([(1, "https://a/x", "one", "2024-01-01"), (2, "https://a/y", "y", "2024-01-01")], [(3, "https://a/x/", "one", "2024-01-02"), (4, "https://a/x", "two", "2024-01-03"), (5, None, "z", "2024-01-03")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r["page_id"]: r["status"] for r in run(spark, jobs.change_status(stream), "changes").collect()}
    assert got == {1: "new", 2: "new", 3: "skipped_unchanged", 4: "updated"}


def test_daily_counts_close_with_the_watermark(spark, tmp_path):
    rows = [(i, f"2024-01-0{1 + i // 10} 10:00:00", "e") for i in range(50)]
    df = spark.createDataFrame(rows, "user_id int, t string, event_type string").withColumn("ts", F.to_timestamp("t"))
    for d in range(1, 6):
        df.where(F.dayofmonth("ts") == d).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {str(r["day"]): r["n"] for r in run(spark, jobs.daily_counts(stream), "days").collect()}
    assert {"2024-01-01": 10, "2024-01-02": 10}.items() <= got.items()
    assert run(spark, jobs.sliding_rates(stream), "rates").count() > 0
    assert run(spark, jobs.sessions(stream), "sess").count() > 0
