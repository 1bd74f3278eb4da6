import json

from sagitta.streaming import download_log as dl


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    event = lambda at, fmt, n: json.dumps({"at": at, "fmt": fmt, "row_count": n, "filters": {"rank": "2", "open": None}, "email": ""})
    (tmp_path / "in" / "a.json").write_text("\n".join([event("2024-01-01T00:10:00Z", "csv", 3), event("2024-01-01T00:50:00Z", "csv", 4)]))
    paths = [str(tmp_path / x) for x in ("in", "log", "ck")]
    for n in (2, 3):
        dl.append_log(dl.events(spark, paths[0]), *paths[1:], once=True).awaitTermination()
        rows = spark.read.parquet(paths[1]).collect()
        assert len(rows) == n and {r["filters"] for r in rows} == {'{"rank":"2"}'} and {r["email"] for r in rows} == {None}
        (tmp_path / "in" / "b.json").write_text(event("2024-01-01T05:00:00Z", "xlsx", 1))
    hours = dl.hourly_counts(dl.events(spark, paths[0])).writeStream.format("memory").queryName("hours").outputMode("append").trigger(availableNow=True).start()
    hours.awaitTermination()
    assert [tuple(r)[1:] for r in spark.sql("SELECT * FROM hours WHERE fmt = 'csv'").collect()] == [("csv", 2, 7)]
