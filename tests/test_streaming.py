import datetime as dt

from seqlake.streaming import reads


def test_stream(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [("r1", "AACG", "IIII", at), ("r2", "aacg", "IIII", at + dt.timedelta(minutes=1)), ("r3", "GG", "!!", at + dt.timedelta(minutes=7))]
    schema = "name string, seq string, qual string, ts timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = reads.stream_tables(spark, str(tmp_path / "in"), schema, 1)

    def result(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name).collect()

    assert {r["rc"] for r in result(reads.encoded(stream), "enc", "append")} == {"CGTT", "CC"}
    assert {r["mean"] for r in result(reads.statistics(stream), "stat", "append")} == {40.0, 0.0}
    assert len(result(reads.distinct_sequences(stream, "ts"), "dist", "append")) == 2
    assert sum(r["reads"] for r in result(reads.counts_by_window(stream, "ts"), "win", "complete")) == 3
