from tracewright.streaming import jobs


def test_latest_of_each_key_over_batches(spark, tmp_path):
    schema = "k int, ts timestamp, id int"
    first = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP '2024-01-01 00:00:00', 1), (2, TIMESTAMP '2024-01-01 00:00:00', 2) AS t(k, ts, id)")
    second = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP '2024-01-02 00:00:00', 3) AS t(k, ts, id)")
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for i, df in enumerate((first, second)):
        df.coalesce(1).write.mode("append").parquet(source)
        jobs.keep_latest(spark.readStream.schema(schema).parquet(source), out, mark, "k", "ts", "id").awaitTermination()
        got = {(r["k"], r["id"]) for r in spark.read.parquet(f"{out}/{i}").collect()}
    assert got == {(1, 3), (2, 2)}


def test_windowed_counts(spark, tmp_path):
    spark.sql("SELECT TIMESTAMP '2024-01-01 00:10:00' AS ts, 'a' AS event_type").write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "in"))
    q = jobs.windowed_counts(events).writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT n FROM w").first()[0] == 1
