"""The daily maximum of eight-hour means on a stream: equal to the table's, and without rows that come too late."""

import json
import os
from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

from gridspark.operators import reduce, select
from gridspark.plans import catalog
from gridspark.streaming import events

SF = "/root/testdata/sf0.001"


def _run(spark, folder, late, name):
    stream = spark.readStream.schema("ts timestamp, k string, value double").option("maxFilesPerTrigger", 1).json(str(folder))
    out = events.daily_maximum_of_means(stream, "ts", "value", ["k"], late)
    q = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(folder) + "_at").start()
    q.processAllAvailable()
    q.stop()
    return {(str(r["day"]), r["k"]): r["maximum"] for r in spark.table(name).collect()}


def _write(folder, parts):
    os.makedirs(folder)
    for i, rows in enumerate(parts):
        path = folder / f"{i:03d}.json"
        path.write_text("\n".join(json.dumps({"ts": t.isoformat(), "k": k, "value": v}) for t, k, v in rows))
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))


def test_stream_equals_table_and_drops_late_rows(spark, tmp_path):
    at = lambda h: datetime(2024, 3, 1, tzinfo=UTC) + timedelta(hours=h)
    rows = [(at(h + 0.25), "a", float(h * 7 % 31)) for h in range(100) if h % 10 != 4] + [(at(h + 0.75), "b", float(h % 5)) for h in range(0, 100, 2)]
    rows.sort()
    # some come an hour late, within what is waited for; the last part moves the watermark beyond all
    swapped = rows[:40] + [x for pair in zip(rows[41:80:2], rows[40:80:2], strict=True) for x in pair] + rows[80:]
    parts = [swapped[i : i + 25] for i in range(0, len(swapped), 25)] + [[(at(400), "end", 1.0)], [(at(401), "end", 1.0)]]
    _write(tmp_path / "in", parts)
    got = _run(spark, tmp_path / "in", "3 hours", "daily_max_1")
    table = spark.createDataFrame(rows, "ts timestamp, k string, value double")
    want = {(str(r["day"]), r["k"]): r["maximum"] for r in events.daily_maximum_of_means(table, "ts", "value", ["k"]).collect()}
    assert want and {k: v for k, v in got.items() if k[1] != "end"} == want
    # a row of the first day that comes after its hours were closed changes nothing
    _write(tmp_path / "late", [*parts[:-2], [(at(2.5), "a", 1e6)], *parts[-2:]])
    got = _run(spark, tmp_path / "late", "3 hours", "daily_max_2")
    assert {k: v for k, v in got.items() if k[1] != "end"} == want


def test_equals_the_cube(spark):
    """Complete days are those of the gridded operator."""
    cube = reduce.mda8(select.subset(catalog.event_cube(spark, SF), ["v"]), "hour").to_frame()
    kinds = sorted(r[0] for r in spark.read.parquet(f"{SF}/events.parquet").select("event_type").distinct().collect())
    want = {(r["hour__i"], kinds[r["etype__i"]]): r["v"] for r in cube.filter("v IS NOT NULL").collect()}
    got = catalog.queries()["stream_daily_maximum"](spark, SF).withColumn("d", F.datediff("day", F.lit("2024-01-01")))
    by = {(r["d"], r["event_type"]): r["maximum"] for r in got.collect()}
    assert want and all(abs(by[k] - v) < 1e-5 for k, v in want.items())
