"""Open periods whatever the order of events; the stream itself is held by its query's SQL."""

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.streaming.ingest import stream_table
from corvane.streaming.keyed_state import Periods, joined, sessions


def in_order(times, idle):
    out = []
    for t in sorted(times):
        if out and t < out[-1][1] + idle:
            out[-1] = (out[-1][0], t, out[-1][2] + 1)
        else:
            out.append((t, t, 1))
    return out


@given(st.lists(st.lists(st.integers(0, 300), max_size=8), max_size=6), st.integers(1, 40))
def test_any_order_and_any_batches(batches, idle):
    open_ = []
    for times in batches:
        open_ = joined(open_, times, idle)
    assert open_ == in_order([t for b in batches for t in b], idle)


def test_ends_of_waits():
    assert Periods(5_000).ends((0, 1_000, 1)) == 6 and Periods(5_000).ends((0, 1_001, 1)) == 7


def test_sessions_over_restarts(spark, tmp_path):
    """Two starts, the second with a late copy: the periods that the watermark has closed, of a null key too, without a call of Python for each key."""
    at = {k: [37 * (k + 1) * i % 2000 for i in range(30)] for k in range(200)}
    rows = [(k if k else None, t) for k, times in at.items() for t in times]
    made = spark.createDataFrame([*rows, (1, 5000)], "k long, s long").select("k", F.timestamp_seconds("s").alias("t"))
    early = F.unix_seconds("t") < 1000
    for part in (made.filter(early), made.filter(~early).union(made.filter(F.unix_seconds("t") < 300))):
        part.write.mode("append").parquet(f"{tmp_path}/in")
        found = sessions(stream_table(spark, f"{tmp_path}/in", made.schema, files=1000), key="k", time="t", idle_seconds=60, late="10 seconds")
        assert "python" not in found._jdf.queryExecution().toString().lower()
        found.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    got = [(r.key, r.a, r.z, r.n) for r in spark.read.parquet(f"{tmp_path}/out").select("key", F.unix_seconds("start").alias("a"), F.unix_seconds("last").alias("z"), "n").collect()]
    want = {(str(k) if k else None, *p) for k, times in at.items() for p in in_order(times, 60)}
    assert sorted(map(str, got)) == sorted(map(str, want))
