"""Set-based forms against sequential simulation, on random events."""

import random
from collections import defaultdict
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wharfline.functions.calendar import Calendar, is_excluded, next_available
from wharfline.functions.text import parse_params, partition_key
from wharfline.operators import graph, keyed
from wharfline.operators.measures import content_fingerprint
from wharfline.streaming import breakers, requests, states

T0 = datetime(2024, 1, 1, tzinfo=UTC)


def events(seed, n=300):
    rng = random.Random(seed)
    return [(rng.choice("abc"), T0 + timedelta(seconds=rng.randrange(20_000)), i, rng.random() < 0.6) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_requests(spark, seed):
    rows = events(seed)
    last, want = {}, set()
    for key, ts, i, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        bucket = int(ts.timestamp() // 600)
        if last.get(key) not in (bucket, bucket - 1):
            last[key] = bucket
            want.add((key, i))
    df = spark.createDataFrame(rows, "k string, ts timestamp, i long, ok boolean")
    assert {(r.k, r.i) for r in requests.dedup_requests(df, ["k"], "ts", "i", 600).collect()} == want


def test_failure_streak(spark):
    rows = [(k, ts, i, "SUCCESS" if ok else "FAILED") for k, ts, i, ok in events(3)]
    streak, want = defaultdict(int), {}
    for k, _, i, s in sorted(rows, key=lambda r: (r[1], r[2])):
        streak[k] = 0 if s == "SUCCESS" else streak[k] + 1
        want[i] = min(10, streak[k])
    df = spark.createDataFrame(rows, "task_id string, created_at timestamp, id long, status string")
    assert {r.id: r.streak for r in keyed.failure_streak(df).collect()} == want


def walked(rule, rows):
    """Status and failures after each result, one by one."""
    status, fails, until, want = defaultdict(lambda: "CLOSED"), defaultdict(int), defaultdict(int), {}
    for k, ts, i, ok in sorted(rows, key=lambda r: (r[1], r[2])):
        ms = int(ts.timestamp() * 1000)
        if status[k] == "OPEN" and ms >= until[k]:
            status[k] = "HALF_OPEN"
        if ok:
            fails[k] = 0
            if status[k] == "HALF_OPEN":
                status[k] = "CLOSED"
        else:
            fails[k] += 1
            if fails[k] >= rule.most_failures or status[k] == "HALF_OPEN":
                status[k], until[k] = "OPEN", ms + rule.cooldown_ms
        want[i] = (status[k], fails[k])
    return want


@pytest.mark.parametrize(("window", "cooldown", "failing", "chunk_bits"), [(4, 300_000, 0.4, 3), (8, 900_000, 0.5, 4), (16, 2_000, 0.6, 5), (6, 0, 0.4, 4), (40, 3_600_000, 0.7, 6), (6, 60_000, 0.5, 16), (20, 5_000, 0.85, 3)])
def test_breaker(spark, window, cooldown, failing, chunk_bits):
    """Chunks of eight rows and more, of which one target has nine in ten; times repeat."""
    rng, rule = random.Random(window), breakers.BreakerRule(window, 0.5, cooldown)
    rows = [("hot" if rng.random() < 0.9 else rng.choice(["a", "b", None]), T0 + timedelta(seconds=rng.randrange(4_000)), i, rng.random() >= failing) for i in range(1_500)]
    df = spark.createDataFrame(rows, "target string, ts timestamp, event_id long, success boolean").repartition(5)
    got = breakers.breaker_states(df, rule, chunk_bits).collect()
    assert len(got) == len(rows)
    assert {r.event_id: (r.status, r.failures) for r in got} == walked(rule, rows)


def test_breaker_cases(spark):
    """No rows; rows without a time take no part; a missing success is a failure; repeated rows count."""
    schema = "target string, ts timestamp, event_id long, success boolean, chunk string"
    assert breakers.breaker_states(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([("a", T0, 1, None, "x"), ("a", T0, 1, None, "x"), ("a", None, 2, True, "x")], schema)
    assert sorted((r.event_id, r.status, r.failures) for r in breakers.breaker_states(df, breakers.BreakerRule(2, 1.0)).collect()) == [(1, "CLOSED", 1), (1, "OPEN", 2)]


def test_hot_breaker_is_spread(spark):
    """One target's results are worked on by many tasks, and what goes through one is a row for each chunk."""
    df = spark.range(200_000).select(F.lit("hot").alias("target"), F.timestamp_millis(F.col("id") * 50).alias("ts"), F.col("id").alias("event_id"), (F.pmod(F.xxhash64("id"), F.lit(3)) > 0).alias("success"))
    rule = breakers.BreakerRule(20, 0.5, 1_000)
    rows = breakers.breaker_states(df, rule, 10).withColumn("task", F.spark_partition_id())
    got = rows.collect()
    assert len({r.task for r in got}) > 1
    want = walked(rule, [("hot", T0 + timedelta(milliseconds=r.event_id * 50), r.event_id, r.ok) for r in df.select("event_id", F.col("success").alias("ok")).collect()])
    assert {r.event_id: (r.status, r.failures) for r in got} == want


def dag(seed, n=60):
    rng = random.Random(seed)
    edges = [(f"n{i}", f"n{j}", rng.choice(["FAIL", "SKIP", "IGNORE", None]), o) for i in range(1, n) for o, j in enumerate(rng.sample(range(i), min(i, rng.randrange(3))))]
    return [(f"n{i}", rng.choice(["SUCCESS"] * 4 + ["FAILED", "PARTIAL"])) for i in range(n)], edges


@pytest.mark.parametrize("fail_fast", [False, True])
def test_propagation(spark, fail_fast):
    nodes, edges = dag(5)
    up = defaultdict(list)
    for a, b, action, o in edges:
        up[a].append((o, b, action or "FAIL"))
    level = {}
    for name, _ in nodes:  # nodes depend on earlier ones only
        level[name] = max((level[b] + 1 for _, b, _ in up[name]), default=0)
    want, broken = {}, False
    for now in range(max(level.values()) + 1):
        here = [(n, r) for n, r in nodes if level[n] == now]
        for n, result in here:
            status = result
            for _, b, action in sorted(up[n]):
                if want[b] in ("FAILED", "PARTIAL") and action != "IGNORE":
                    status = "SKIPPED" if action == "SKIP" else "FAILED"
                    break
            want[n] = "SKIPPED" if broken else status
        broken = broken or fail_fast and any(want[n] == "FAILED" for n, _ in here)
    nd = spark.createDataFrame(nodes, "task_id string, status string")
    ed = spark.createDataFrame(edges, "task_id string, depends_on string, action string, ordinal int")
    assert {r.task_id: r.status for r in graph.propagate(nd, ed, nd, fail_fast).collect()} == want
    assert {r.task_id: r.level for r in graph.topo_levels(nd, ed)[0].collect()} == level


def test_cycles(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "task_id string")
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("b", "c"), ("d", "c")], "task_id string, depends_on string")
    levels, rest = graph.topo_levels(nodes, edges)
    assert [r.task_id for r in levels.collect()] == ["a"] and {r.task_id for r in rest.collect()} == {"b", "c", "d"}
    assert graph.has_cycle(nodes, edges)


def test_deep_graph(spark):
    """A chain is no cycle, however deep."""
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(13)], "task_id string")
    edges = spark.createDataFrame([(f"n{i}", f"n{i - 1}") for i in range(1, 13)], "task_id string, depends_on string")
    levels, rest = graph.topo_levels(nodes, edges)
    assert {r.task_id: r.level for r in levels.collect()} == {f"n{i}": i for i in range(13)} and rest.isEmpty()


def test_overlapping_starts(spark, tmp_path):
    """The stream finds the timeouts that the batch form finds, also of starts that overlap."""
    rng = random.Random(7)
    schema = "key string, ts timestamp, kind string"
    rows = sorted((rng.choice("abc"), T0 + timedelta(seconds=rng.randrange(20_000)), rng.choice(["START", "START", "END"])) for _ in range(120))
    rows.sort(key=lambda r: r[1])
    source = str(tmp_path / "in")
    for part in (rows[:40], rows[40:80], rows[80:], [("z", T0 + timedelta(seconds=90_000), "END")], [("z", T0 + timedelta(seconds=99_000), "END")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = states.stream_timeouts(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), 20)
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    finally:
        spark.conf.unset(key)
    want = states.timeouts(spark.createDataFrame(rows, schema), "key", "ts", 20, F.lit(T0 + timedelta(seconds=80_000)))
    assert sorted((r.key, r.due_ms) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted((r.key, int(r.due_at.timestamp() * 1000)) for r in want.collect())


def test_requests_as_stream(spark, tmp_path):
    """One micro-batch, in a session of another time zone."""
    rows = [(k, ts, i) for k, ts, i, _ in events(9)]
    df = spark.createDataFrame(rows, "dedup_key string, ts timestamp, request_id long")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    settings = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.session.timeZone": "Asia/Tokyo"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        stream = requests.stream_requests(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 600)
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    got = {(r.dedup_key, r.request_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(r.dedup_key, r.request_id) for r in requests.dedup_requests(df, ["dedup_key"], "ts", "request_id", 600).collect()}


def test_content_fingerprint(spark):
    import zlib

    texts = ["a", "b", "", "é", "a", None]
    got = content_fingerprint(spark.createDataFrame([(t,) for t in texts], "text string"), "text").first()
    sums = [zlib.crc32(t.encode()) for t in texts if t is not None]
    xor = 0
    for x in sums:
        xor ^= x
    assert (got.n, got.crc_sum, got.crc_xor) == (6, sum(sums), xor)


def test_timeouts_as_stream(spark, tmp_path):
    at = lambda s: T0 + timedelta(seconds=s)
    schema = "key string, ts timestamp, kind string"
    source = str(tmp_path / "in")
    for rows in ([("a", at(0), "START"), ("b", at(5), "START"), ("b", at(30), "END")], [("c", at(4000), "START")], [("d", at(9000), "END")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = states.stream_timeouts(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), 10)
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    finally:
        spark.conf.unset(key)
    got = {(r.key, r.due_ms) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got >= {("a", int(at(600).timestamp() * 1000))} and not any(k == "b" for k, _ in got)


def test_calendar(spark):
    calendar = Calendar(("2024-01-03",), True, (("22:00:00", "06:00:00"),))
    times = ["2024-01-01 12:00:30", "2024-01-01 23:00:00", "2024-01-03 12:00:00", "2024-01-05 22:30:15", "2024-01-06 10:00:00"]
    df = spark.createDataFrame([(t,) for t in times], "t string").select(F.to_timestamp("t").alias("t"))
    got = [(r.out, r.next.strftime("%d %H:%M:%S")) for r in df.select("t", is_excluded("t", calendar).alias("out"), next_available("t", calendar).alias("next")).orderBy("t").collect()]
    assert got == [(False, "01 12:00:30"), (True, "02 06:01:00"), (True, "04 06:01:00"), (True, "08 06:00:15"), (True, "08 06:01:00")]
    assert df.select(is_excluded("t", None).alias("x")).distinct().first().x is False


def test_params_isolate_bad_pieces(spark):
    df = spark.createDataFrame([("a=1+2&b=%zz&c&d=x=y&a=3",)], "p string")
    assert df.select(parse_params("p").alias("m")).first().m == {"d": "x=y", "a": "3"}


def test_pages_by_key(spark):
    df, last, seen = spark.range(23).toDF("id"), None, []
    while rows := keyed.page_after(df, "id", 5, last).collect():
        seen += [r.id for r in rows]
        last = seen[-1]
    assert seen == list(range(23))


def test_partition_keys(spark):
    df = spark.createDataFrame([("2024-05-06",), ("2024/05/06",), ("20240506",), ("2024_05",), ("x",), (" ",), (None,)], "d string")
    got = [r.k for r in df.select(partition_key("d", F.to_timestamp(F.lit("2025-02-03"))).alias("k")).collect()]
    assert got == ["2024_05", "2024_05", "2024_05", "2024_05", "x", "2025_02", "2025_02"]


def test_request_state_stays_small(spark, tmp_path):
    """Keys that come once each: after many micro-batches the state holds those of the last two buckets only."""
    from wharfline.streaming.requests import stream_requests

    for n in range(8):
        rows = [(f"k{n}-{i}", datetime(2024, 1, 1, n, i), n * 100 + i) for i in range(50)]
        spark.createDataFrame(rows, "dedup_key string, ts timestamp, request_id long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("dedup_key string, ts timestamp, request_id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = stream_requests(stream, 3600).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination()
    finally:
        spark.conf.unset(key)
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 400
    # a row of state and its timer's rows for each key of two buckets or three
    assert max(kept[4:]) <= max(kept[:4]), kept


def levels_of(n, links):
    """Levels by repeated relaxation; nodes in or behind cycles have none."""
    ups = defaultdict(set)
    for a, b in links:
        ups[a].add(b)
    level = {}
    while new := {v: 1 + max((level[u] for u in ups[v]), default=-1) for v in range(n) if v not in level and all(u in level for u in ups[v])}:
        level |= new
    return level


@pytest.mark.parametrize("kind", ["random", "cyclic", "ladder", "tree"])
def test_levels_of_graphs(spark, kind):
    rng = random.Random(len(kind))
    n = 60 if kind != "ladder" else 16
    links = {
        "random": [(a, rng.randrange(a)) for a in range(1, n) for _ in range(rng.choice([0, 1, 1, 2, 3]))],
        "cyclic": [(rng.randrange(n), rng.randrange(n)) for _ in range(50)],
        "ladder": [(a, a - k) for a in range(n) for k in (1, 2) if a >= k],
        "tree": [(a, (a - 1) // 2) for a in range(1, n)],
    }[kind]
    name = "n{:02d}".format
    nodes = spark.createDataFrame([(name(i),) for i in range(n)], "task_id string")
    edges = spark.createDataFrame([(name(a), name(b)) for a, b in links], "task_id string, depends_on string")
    levels, rest = graph.topo_levels(nodes, edges)
    want = levels_of(n, links)
    assert {r.task_id: r.level for r in levels.collect()} == {name(i): k for i, k in want.items()}
    assert {r.task_id for r in rest.collect()} == {name(i) for i in range(n) if i not in want}
    if kind == "cyclic":
        reach = {i: {b for a, b in links if a == i} for i in range(n)}
        for _ in range(n):
            reach = {i: r.union(*(reach[j] for j in r)) for i, r in reach.items()}
        found = {r.task_id: r.component for r in graph.cycle_members(nodes, edges).collect()}
        assert found == {name(i): name(max(j for j in reach[i] | {i} if i in reach[j] or i == j)) for i in range(n) if i in reach[i]} and found


def test_a_chain_takes_few_rounds(spark):
    """A chain of 100,000 and a cycle with a tail, in steps that grow with the logarithm."""
    n = 100_000
    nodes = spark.range(n).select(F.col("id").cast("string").alias("task_id"))
    edges = spark.range(1, n).select(F.col("id").cast("string").alias("task_id"), (F.col("id") - 1).cast("string").alias("depends_on"))
    levels, rest = graph.topo_levels(nodes, edges)
    assert levels.filter("level <> CAST(task_id AS INT)").count() == 0 and levels.count() == n and rest.count() == 0
    round_ = edges.unionByName(spark.createDataFrame([("0", "60000")], edges.schema))
    levels, rest = graph.topo_levels(nodes, round_)
    assert levels.count() == 0 and rest.count() == n


def test_requests_by_groups_of_keys(spark, tmp_path):
    """Many keys over several micro-batches as sequential Python decides; keys share rows of state, so that Python isn't called for each."""
    from wharfline.streaming.requests import GROUPS, stream_requests

    rng = random.Random(4)
    schema = "dedup_key string, ts timestamp, request_id long"
    want, last, n = set(), {}, 0
    for batch in range(4):
        rows = []
        for _ in range(1500):
            n += 1
            rows.append((rng.choice([None, f"k{rng.randrange(900)}", f"h{rng.randrange(3)}"]), datetime(2024, 1, 1) + timedelta(seconds=batch * 1500 + rng.randrange(1500)), n))
        first = {}
        for k, ts, i in rows:
            at = (k, int((ts - datetime(2024, 1, 1)).total_seconds()) // 300)
            first[at] = min(first.get(at, (ts, i)), (ts, i))
        for (k, b), (_, i) in sorted(first.items(), key=lambda x: x[0][1]):
            if k not in last or b not in (last[k], last[k] + 1):
                last[k] = b
                want.add((k, i))
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = stream_requests(stream, 300).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination()
    finally:
        spark.conf.unset(key)
    assert {(r.dedup_key, r.request_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= GROUPS < len(last)
