"""Late rows and upserts of streams."""

import uuid

from pyspark.sql import functions as F

from driftloom.operators import checks
from driftloom.operators.lineage import shared_folder
from driftloom.streaming import jobs


def _stream(spark, rows, schema):
    """One batch for each list of rows."""
    at = f"{shared_folder(spark)}/late-{uuid.uuid4().hex}"
    for batch in rows:
        spark.createDataFrame(batch, schema).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{at}/in")
    return spark.readStream.schema(spark.read.parquet(f"{at}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in"), at


def test_late_beats(spark):
    beats = [[("a", "2024-01-01 12:00:00")], [("a", "2024-01-01 11:30:00"), ("a", "2024-01-02 12:00:00")], [("y", "2024-01-02 12:30:00")], [("a", "2024-01-01 11:00:00"), ("z", "2024-02-01 00:00:00")], [("z", "2024-03-01 00:00:00")]]
    counts = {}
    for late in ("1 hour", "3 days"):
        stream, at = _stream(spark, beats, "host string, ts string")
        out = jobs.drain(jobs.host_sessions(stream, "40 minutes", late), at)
        counts[late] = out.filter("host = 'a'").agg(F.sum("beats")).first()[0]
    assert counts == {"1 hour": 3, "3 days": 4}


def test_late_results(spark):
    asked, at = _stream(spark, [[(1, 1, "2024-01-01 00:00:00")], [(2, 1, "2024-03-01 00:00:00")]], "app long, id long, ts string")
    found, _ = _stream(spark, [[(9, 9, "2024-01-03 00:00:00")], [(1, 1, "2024-01-01 00:30:00"), (9, 9, "2024-03-01 00:00:00")]], "app long, id long, ts string")
    out = jobs.drain(jobs.wait_for_results(asked.withColumnRenamed("ts", "asked"), found.withColumn("return_value", F.lit(1)), "1 hour", "3 days"), at)
    assert [(r.app, r.return_value) for r in out.filter("app = 1").collect()] == [(1, 1)]


def test_upserts_rewrite_touched_buckets_only(spark):
    path = f"{shared_folder(spark)}/upserts-{uuid.uuid4().hex}"
    write = jobs.upsert_into(path, ["k"], buckets=8)
    schema = "k long, v long"
    write(spark.range(100).select(F.col("id").alias("k"), F.lit(0).cast("long").alias("v")), 0)
    write(spark.createDataFrame([(5, 1), (200, 1)], schema), 1)
    write(spark.createDataFrame([(5, 1), (200, 1)], schema), 1)  # a repeated batch writes its version again
    got = {r.k: r.v for r in jobs.read_upserts(spark, path).collect()}
    assert got == {**dict.fromkeys(range(100), 0), 5: 1, 200: 1}
    write(spark.createDataFrame([], schema), 2)
    assert jobs.read_upserts(spark, path).count() == len(got)


def _drained(stream, at):
    """What an append job gave, and the rows that its state holds at the end."""
    with jobs.rocksdb(stream.sparkSession):
        query = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start()
        query.awaitTermination()
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/out"), rows


def test_expired_values_leave_the_state(spark):
    """200 keys with a lifetime of 10 s and one without: once time goes on, only the one is kept."""
    at = f"{shared_folder(spark)}/ttl-{uuid.uuid4().hex}"
    schema = "key long, seq long, at double, op string, arg string, ttl double, offset int"
    batches = [[(k, k, 1.0, "set", "v", 10.0, None) for k in range(200)] + [(500, 200, 1.0, "set", "stays", None, None)],
               [(3, 301, 5.0, "expire", None, 5000.0, None), (500, 302, 6.0, "append", "x", None, None)], [(900, 400, 1000.0, "del", None, None, None)],
               [(3, 501, 1100.0, "setnx", "late", None, None), (4, 502, 1100.0, "setnx", "new", 1.0, None), (900, 503, 1200.0, "del", None, None, None)], [(900, 600, 2000.0, "del", None, None, None)], [(900, 700, 3000.0, "del", None, None, None)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{at}/in")
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    out, rows = _drained(jobs.live_state(read(), late="10 seconds"), f"{at}/timed")
    plain, kept = _drained(jobs.live_state(read()), f"{at}/plain")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, plain.collect()))
    told = {r.seq: (r.done, r.value) for r in out.collect()}
    assert told[501] == (False, "v") and told[502] == (True, "new") and told[302] == (True, "stays")
    assert max(rows) > 200 and rows[-1] < 20 < 200 < kept[-1]


def test_silent_hosts_leave_the_registry(spark):
    at = f"{shared_folder(spark)}/hosts-{uuid.uuid4().hex}"
    schema = "seq long, host long, op string, ts timestamp, slots long, used long, overwrite boolean"
    when = lambda s: f"2024-01-01 {s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}"
    batches = [[(h, h, "register", when(0), 4, 0, False) for h in range(100)], [(200, 1, "register", when(4), 9, 0, False), (201, 2, "register", when(4), 9, 1, True), (202, 3, "remove", when(4), 0, 0, False), (203, 4, "register", when(4), -1, 0, True)],
               [(300, 500, "register", when(600), 1, 0, False)], [(400, 5, "register", when(700), 7, 0, False)], [(500, 500, "register", when(1400), 1, 0, False)], [(600, 500, "register", when(2400), 1, 0, False)]]
    for rows in batches:
        spark.createDataFrame(rows, "seq long, host long, op string, ts string, slots long, used long, overwrite boolean").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{at}/in")
    log = spark.read.schema(schema).parquet(f"{at}/in")
    out, rows = _drained(jobs.live_registry(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in"), 60, "10 seconds"), at)
    last = {}
    for r in sorted((r for r in out.collect() if r.event != "silent"), key=lambda r: r.seq):
        last[r.host] = r
    found = {(r.host, r.slots, r.used, r.register_ts) for r in last.values() if r.event == "live"}
    assert found == {tuple(r) for r in checks.host_registry(log.withColumn("ts", F.unix_millis("ts")), 60).collect()}
    assert {r.host for r in out.filter("event = 'silent'").collect()} >= set(range(100)) - {3}
    assert max(rows) >= 99 and rows[-1] <= 4


def test_waiting_joins_by_slices(spark, tmp_path):
    """The waiting is keyed by time slices too, so a busy task is not one group; results at both ends of the time-out."""
    from datetime import datetime, timedelta

    at = datetime(2024, 1, 1, 23, 30)
    asked = [(1, 1, at + timedelta(minutes=k * 50)) for k in range(12)]
    found = [(1, 1, at + timedelta(minutes=60 * k), 0) for k in range(4)]
    far = datetime(2030, 1, 1)
    q = spark.createDataFrame([*asked, (-1, 0, far)], "app long, id long, asked timestamp")
    r = spark.createDataFrame([*found, (-1, 0, far, 0)], "app long, id long, ts timestamp, return_value int")
    stream = jobs.wait_for_results(jobs.stream_of(q, f"{tmp_path}/q", "asked"), jobs.stream_of(r, f"{tmp_path}/r", "ts"), "2 hours")
    assert "_slice" in stream._jdf.queryExecution().logical().toString()
    got = sorted(str((x.asked, x.ts)) for x in jobs.drain(stream, str(tmp_path)).filter("app >= 0").collect())
    within = lambda a: [f[2] for f in found if a <= f[2] <= a + timedelta(hours=2)] or [None]
    assert got == sorted(str((a[2], f)) for a in asked for f in within(a[2]))


class _Fake:
    """State held in a dict; counts what is written."""

    def __init__(self):
        self.held, self.writes = {}, 0

    def get(self):
        return self.held.get("it")

    def exists(self):
        return "it" in self.held

    def update(self, value):
        self.held["it"], self.writes = value, self.writes + 1

    def containsKey(self, k):
        return k in self.held

    def getValue(self, k):
        return self.held[k]

    def updateValue(self, k, value):
        self.held[k], self.writes = value, self.writes + 1

    def removeKey(self, k):
        del self.held[k]
        self.writes += 1


class _Handle:
    def __init__(self):
        self.states = []

    def getValueState(self, *_):
        self.states.append(_Fake())
        return self.states[-1]

    getMapState = getValueState


def test_reorder_writes_blocks_not_messages():
    import pandas as pd

    job, handle = jobs.Reorder(), _Handle()
    job.init(handle)
    seqs = list(range(1, 10_000))
    give = lambda s: [r.seq for pdf in job.handleInputRows((1, 2, 3), iter([pd.DataFrame({"seq": s, "arrival": s})]), None) for r in pdf.itertuples()]
    assert give(seqs[::-1]) == [] and sum(s.writes for s in handle.states) <= 3
    assert give([0]) == list(range(10_000)) and sum(s.writes for s in handle.states) <= 10
    assert give([3, 10_000]) == [10_000] and not handle.states[1].held


def test_progress_writes_blocks_not_tasks():
    import pandas as pd

    job, handle = jobs.BatchProgress(), _Handle()
    job.init(handle)
    n = 200
    give = lambda ids, code: [tuple(r) for pdf in job.handleInputRows((1,), iter([pd.DataFrame({"seq": range(len(ids)), "id": ids, "return_value": code, "expected": n})]), None) for r in pdf.itertuples(index=False)]
    assert give(list(range(50)), jobs.FROZEN) == [] and give(list(range(n - 1)), 1) == [] and give([0], 0) == []
    assert give([n - 1], 0) == [(1, n, n - 2, 50)] and sum(s.writes for s in handle.states) <= 8
