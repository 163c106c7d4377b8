"""Streams with timers, and arrivals taken through the chain once."""

from __future__ import annotations

import shutil

from pyspark.sql import functions as F

from lodestone.plans.chain import Chain, Stage
from lodestone.streaming.ingest import ingest_arrivals
from lodestone.streaming.progress import watch_progress

REPORT = "document_id string, stage string, done long, total long, at timestamp"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def test_silence_is_told_when_the_clock_passes(spark, tmp_path):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        source, seen = tmp_path / "in", []
        source.mkdir()

        def report(*rows):
            made = spark.createDataFrame([(d, "PARSING", n, 9, at) for d, n, at in rows], "document_id string, stage string, done long, total long, at string").withColumn("at", F.to_timestamp("at"))
            made.coalesce(1).write.mode("append").parquet(str(source))
            stream = watch_progress(spark.readStream.schema(REPORT).parquet(str(source)), late="0 seconds")
            query = stream.writeStream.foreachBatch(lambda b, _: seen.extend((r.document_id, r.done, r.state) for r in b.collect())).outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
            query.awaitTermination()
            out = sorted(seen)
            seen.clear()
            return out

        assert report(("a", 1, "2024-01-01 00:00:00"), ("b", 1, "2024-01-01 00:00:00"), ("a", 2, "2024-01-01 00:01:00")) == [("a", 2, "RUNNING"), ("b", 1, "RUNNING")]
        assert report(("a", 5, "2024-01-01 00:09:00")) == [("a", 5, "RUNNING")]
        assert report(("c", 1, "2024-01-01 00:10:30")) == [("b", 1, "STALLED"), ("c", 1, "RUNNING")]  # a was heard of in time
        assert report(("c", 2, "2024-01-01 00:19:30")) == [("a", 5, "STALLED"), ("c", 2, "RUNNING")]
        assert report(("a", 6, "2024-01-01 00:20:00")) == [("a", 6, "RUNNING")]
        assert report(("d", 1, "2024-01-01 01:00:30")) == [("a", 6, "STALLED"), ("b", 1, "FORGOTTEN"), ("c", 2, "STALLED"), ("d", 1, "RUNNING")]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if old is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def test_arrivals_are_taken_once_and_a_replayed_batch_changes_nothing(spark, tmp_path):
    schema = "document_id string, content_fp string"
    asked = []

    def one(t):
        asked.append(sorted(r[0] for r in t["documents"].select("document_id").collect()))
        return t["documents"].select("document_id")

    chain = Chain(spark, str(tmp_path / "chain"), [Stage("one", one, "document_id string")])
    folder = str(tmp_path / "in")
    for rows in ([("a", "1"), ("b", "1")], [("c", "1"), ("a", "1")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    take = lambda: ingest_arrivals(spark, folder, schema, chain, str(tmp_path / "check"), 1).awaitTermination()
    take()
    assert sorted(sum(asked, [])) == ["a", "b", "c"] and len(asked) == 2
    commits = sorted(p for p in (tmp_path / "check" / "commits").iterdir() if p.name.isdigit())
    commits[-1].with_name(f".{commits[-1].name}.crc").unlink()
    commits[-1].unlink()  # killed before the last batch was told done
    shutil.rmtree(tmp_path / "chain" / "_arrivals" / "batch=000001")
    take()
    assert sorted(sum(asked, [])) == ["a", "b", "c"]
    assert sorted(r.document_id for r in chain.rows("one").collect()) == ["a", "b", "c"]
    spark.createDataFrame([("a", "2")], schema).coalesce(1).write.mode("append").parquet(folder)
    take()
    assert asked[-1] == ["a"]
