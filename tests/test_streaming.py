from datetime import datetime, timedelta

from ledgerloom.streaming.interval_join import assign_batch, streaming_candidates


def test_interval_join(spark, tmp_path):
    base = datetime(2024, 1, 1)
    t = spark.createDataFrame([("t1", "5251", 1000, "GBP", base), ("t2", "", 1000, "EUR", base)], "transaction_id string, mcc string, amount_minor bigint, currency string, occurred_at timestamp")
    r = spark.createDataFrame([("r1", 1000, "GBP", base + timedelta(hours=3)), ("r2", 1000, "GBP", base + timedelta(days=9)), ("r3", 9000, "GBP", base)], "slip_id string, total_minor bigint, currency string, issued_at timestamp")
    t.write.parquet(f"{tmp_path}/t")
    r.write.parquet(f"{tmp_path}/r")
    ts, rs = spark.readStream.schema(t.schema).parquet(f"{tmp_path}/t"), spark.readStream.schema(r.schema).parquet(f"{tmp_path}/r")
    q = streaming_candidates(ts, rs).writeStream.format("memory").queryName("pairs").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert [(x.transaction_id, x.slip_id) for x in spark.sql("select * from pairs").collect()] == [("t1", "r1")]


def test_batch_assignment(spark):
    base = datetime(2024, 1, 1)
    rows = [("transaction", 0, "t1", "SCREWFIX", "5251", 1000, "GBP", base), ("slip", 0, "r1", "Screwfix", None, 1000, "GBP", base)]
    seen = []
    assign_batch(lambda m, i: seen.extend((x.transaction_id, x.slip_id, i) for x in m.collect()))(spark.createDataFrame(rows, "side string, ordinal bigint, id string, name string, mcc string, amount bigint, currency string, at timestamp"), 7)
    assert seen == [("t1", "r1", 7)]
