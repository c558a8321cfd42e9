"""Dependency graphs as edge tables. Each step writes a table, so that plans stay short; no graph is collected."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wharfline.shared import remove, shared_dir


def materialize(spark: SparkSession, df: DataFrame, name: str = "graph") -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back."""
    return _written(spark, df, shared_dir(spark, name))


def _written(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Steps:
    """Tables of the steps of one computation, which go when it ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.count = spark, shared_dir(spark, "graph-steps"), 0

    def table(self, df: DataFrame) -> DataFrame:
        self.count += 1
        return _written(self.spark, df, f"{self.path}/{self.count}")

    def __enter__(self) -> Steps:
        return self

    def __exit__(self, *_: object) -> None:
        remove(self.spark, self.path)


def graph_snapshot(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """kind, a, b: nodes and edges; the counts are those of the kinds."""
    nodes = tasks.select(F.lit("NODE").alias("kind"), F.col("task_id").alias("a"), F.lit(None).cast("string").alias("b"))
    return nodes.unionByName(edges.select(F.lit("EDGE").alias("kind"), F.col("depends_on").alias("a"), F.col("task_id").alias("b")))


def follow(steps: Steps, pointers: DataFrame) -> DataFrame:
    """node, to, b, w: pointers followed to the first node that has none, by doubling; those that never end are left out.

    A pointer says that a node's level is the larger of ``b`` (null: nothing known) and that of ``to`` plus ``w``;
    two in a row are one of the same kind.
    """
    n, rounds = pointers.count(), 0
    while n >> rounds:
        nxt = pointers.select(F.col("node").alias("mid"), F.col("to").alias("on"), F.col("b").alias("b2"), F.col("w").alias("w2"))
        both = pointers.join(nxt, F.col("to") == F.col("mid"), "left")
        moved = both.agg(F.count("on").alias("n")).first().n
        if not moved:
            return pointers
        pointers = steps.table(both.select("node", F.coalesce("on", "to").alias("to"), F.greatest("b", F.col("b2") + F.col("w")).alias("b"), (F.col("w") + F.coalesce("w2", F.lit(0))).alias("w")))
        rounds += 1
    # more steps than there are nodes: what still leads to a pointer goes round in a cycle
    return pointers.join(pointers.select(F.col("node").alias("to")), "to", "left_anti").select("node", "to", "b", "w")


def topo_levels(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(levels, rest): each node's level, one above the highest it depends on, and the nodes in or behind cycles.

    In each round, upstreams of known level become a bound of the nodes behind them; nodes with no other upstream are
    settled; nodes with one other are followed to where a node has several, by doubling, and hang on that one. What is
    left has several upstreams each. So chains and trees of any depth take a number of steps that grows with the logarithm
    of their depth, and rounds are as many as there are joins in a row. Upstreams that aren't nodes are never settled.
    """
    spark = nodes.sparkSession
    with Steps(spark) as steps:
        links = steps.table(edges.select(F.col("task_id").alias("node"), F.col("depends_on").alias("up")).distinct().join(nodes.select(F.col("task_id").alias("node")).distinct(), "node", "left_semi").withColumn("w", F.lit(1)))
        waiting = steps.table(links.select("node").distinct().withColumn("b", F.lit(None).cast("int")))
        new = steps.table(nodes.select(F.col("task_id").alias("node")).distinct().join(waiting, "node", "left_anti").select("node", F.lit(0).alias("level")))
        settled, hung, left = [new], [], waiting.count()
        while left:
            met = links.join(new.select(F.col("node").alias("up"), "level"), "up", "left")
            state = met.groupBy("node").agg(F.max(F.col("level") + F.col("w")).alias("known"), F.count_if(F.col("level").isNull()).alias("open"), F.max(F.when(F.col("level").isNull(), F.struct("up", "w"))).alias("last"))
            state = steps.table(waiting.join(state, "node").select("node", F.greatest("b", "known").alias("b"), "open", "last"))
            free = state.filter("open = 0").select("node", F.col("b").alias("level"))
            ends = follow(steps, state.filter("open = 1").select("node", F.col("last.up").alias("to"), "b", F.col("last.w").alias("w")))
            # what hangs on a node that is settled now is settled too
            reached = ends.join(free.select(F.col("node").alias("to"), "level"), "to", "left")
            reached = steps.table(reached.select("node", "to", "b", "w", F.greatest("b", F.col("level") + F.col("w")).alias("value"), F.col("level").isNotNull().alias("done")))
            new = free.unionByName(reached.filter("done").select("node", F.col("value").alias("level")))
            later = reached.filter("NOT done").select("node", "to", "b", "w")
            gone = new.count(), later.count()
            settled.append(new)
            if gone[1]:
                hung.append(later)
            left -= sum(gone)
            if not left or not sum(gone):
                break
            # links of the others: known upstreams are in the bound, hanging ones are replaced by what they hang on
            others = state.filter("open > 1").select("node", "b")
            rest = met.filter("level IS NULL").select("node", "up", "w").join(others.select("node"), "node", "left_semi")
            if not gone[1]:
                waiting, links = others, steps.table(rest)
                continue
            rest = rest.join(later.select(F.col("node").alias("up"), "to", F.col("b").alias("b2"), F.col("w").alias("w2")), "up", "left")
            rest = steps.table(rest.select("node", F.coalesce("to", "up").alias("up"), (F.col("w") + F.coalesce("w2", F.lit(0))).alias("w"), (F.col("b2") + F.col("w")).alias("via")))
            waiting = others.join(rest.groupBy("node").agg(F.max("via").alias("via")), "node", "left").select("node", F.greatest("b", "via").alias("b"))
            links = steps.table(rest.groupBy("node", "up").agg(F.max("w").alias("w")))
        levels = reduce(DataFrame.unionByName, settled)
        for later in reversed(hung):
            known = later.join(levels.select(F.col("node").alias("to"), "level"), "to").select("node", F.greatest("b", F.col("level") + F.col("w")).alias("level"))
            levels = steps.table(levels.unionByName(known))
        levels = materialize(spark, levels.select(F.col("node").alias("task_id"), F.col("level").cast("int").alias("level")))
        return levels, materialize(spark, nodes.select("task_id").distinct().join(levels.select("task_id"), "task_id", "left_anti"))


def cycle_members(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """task_id, component: the nodes that lie on a cycle, with the largest name of those they share cycles with.

    Nodes that no cycle leads to, and nodes that lead to none, are taken off first. Of the others, each takes the largest name
    that leads to it; those of one name that lead back to its bearer are a component. That takes as many steps
    as the longest way through them.
    """
    spark = nodes.sparkSession
    inside = lambda links, kept: links.join(kept.select(F.col("task_id").alias("node")), "node", "left_semi").join(kept.select(F.col("task_id").alias("up")), "up", "left_semi").select("node", "up")
    with Steps(spark) as steps:
        links = edges.select(F.col("task_id").alias("node"), F.col("depends_on").alias("up")).distinct()
        rest = topo_levels(nodes, edges)[1]
        links = steps.table(inside(links, rest))
        rest = topo_levels(rest, links.select(F.col("up").alias("task_id"), F.col("node").alias("depends_on")))[1]
        links, left, found = steps.table(inside(links, rest)), rest.select(F.col("task_id").alias("node")), []
        while not left.isEmpty():
            names = steps.table(left.withColumn("name", F.col("node")))
            while True:
                above = links.join(names.select(F.col("node").alias("up"), F.col("name").alias("theirs")), "up").groupBy("node").agg(F.max("theirs").alias("theirs"))
                nxt = steps.table(names.join(above, "node", "left").select("node", F.greatest("name", "theirs").alias("name"), (F.col("theirs") > F.col("name")).alias("moved")))
                names = nxt.select("node", "name")
                if nxt.filter("moved").isEmpty():
                    break
            back = new = steps.table(names.filter("node = name"))
            while not new.isEmpty():
                up = links.join(new, "node").select(F.col("up").alias("node"), "name").distinct()
                new = steps.table(up.join(names, ["node", "name"], "left_semi").join(back, "node", "left_anti"))
                back = steps.table(back.unionByName(new))
            sizes = back.groupBy("name").agg(F.count("*").alias("n"))
            alone = links.filter("node = up").select("node", F.lit(True).alias("self"))
            found.append(steps.table(back.join(sizes, "name").join(alone, "node", "left").filter("n > 1 OR self").select(F.col("node").alias("task_id"), F.col("name").alias("component"))))
            left = steps.table(left.join(back, "node", "left_anti"))
            links = steps.table(inside(links, left.select(F.col("node").alias("task_id"))))
        none = nodes.select("task_id", F.col("task_id").alias("component")).limit(0)
        return materialize(spark, reduce(DataFrame.unionByName, found, none))


def has_cycle(nodes: DataFrame, edges: DataFrame) -> bool:
    return not topo_levels(nodes, edges)[1].isEmpty()


def propagate(nodes: DataFrame, edges: DataFrame, results: DataFrame, fail_fast: bool = False) -> DataFrame:
    """task_id, status: what each task of a run ends as, if those that are ready end as in ``results``.

    edges: task_id, depends_on, action (FAIL by default, SKIP, IGNORE), ordinal. The first edge in order that
    decides counts: a failed or partial upstream fails or skips the task or is ignored. Tasks without a result
    fail. Fail-fast: once a level holds a failure, tasks of later levels are skipped. Tasks in or behind
    cycles fail.
    """
    spark = nodes.sparkSession
    levels, rest = topo_levels(nodes, edges)
    top = levels.agg(F.max("level")).first()[0]
    results = results.select("task_id", F.col("status").alias("result"))
    path = shared_dir(spark, "propagate")
    # tasks by their level, and edges by that of their upstream: each is read once
    levels.join(results, "task_id", "left").select("task_id", "level", F.coalesce("result", F.lit("FAILED")).alias("result")).write.partitionBy("level").parquet(f"{path}/tasks")
    action = F.upper(F.trim(F.coalesce("action", F.lit("FAIL"))))
    live = edges.select("task_id", "depends_on", action.alias("action"), "ordinal").filter("action <> 'IGNORE'")
    live = live.join(levels.select("task_id", F.col("level").alias("at")), "task_id").join(levels.select(F.col("task_id").alias("depends_on"), F.col("level").alias("from")), "depends_on")
    live.write.partitionBy("from").parquet(f"{path}/edges")
    tasks, live = spark.read.schema("task_id string, result string, level int").parquet(f"{path}/tasks"), spark.read.schema(live.schema).parquet(f"{path}/edges")
    held = "task_id string, action string, ordinal bigint, at int"
    statuses = "task_id string, status string, level int"
    spark.createDataFrame([], held).write.partitionBy("at").parquet(f"{path}/held")
    spark.createDataFrame([], statuses).write.partitionBy("level").parquet(f"{path}/status")
    broken = False
    for level in range((top if top is not None else -1) + 1):
        here = tasks.filter(F.col("level") == level)
        if broken:
            now = here.select("task_id", F.lit("SKIPPED").alias("status"))
        else:
            first = spark.read.schema(held).parquet(f"{path}/held").filter(F.col("at") == level).groupBy("task_id").agg(F.min_by("action", "ordinal").alias("action"))
            status = F.when(F.col("action") == "SKIP", "SKIPPED").when(F.col("action").isNotNull(), "FAILED").otherwise(F.col("result"))
            now = here.join(first, "task_id", "left").select("task_id", status.alias("status"))
        now.withColumn("level", F.lit(level)).write.mode("append").partitionBy("level").parquet(f"{path}/status")
        now = spark.read.schema(statuses).parquet(f"{path}/status").filter(F.col("level") == level)
        bad = now.filter(F.col("status").isin("FAILED", "PARTIAL")).select(F.col("task_id").alias("depends_on"))
        if not broken:
            behind = live.filter(F.col("from") == level).join(bad, "depends_on", "left_semi")
            behind.select("task_id", "action", F.col("ordinal").cast("bigint").alias("ordinal"), "at").write.mode("append").partitionBy("at").parquet(f"{path}/held")
        broken = broken or fail_fast and not now.filter("status = 'FAILED'").isEmpty()
    stuck = rest.select("task_id", F.lit("SKIPPED" if broken else "FAILED").alias("status"))
    return spark.read.schema(statuses).parquet(f"{path}/status").select("task_id", "status").unionByName(stuck)


def dependency_state(tasks: DataFrame, deps: DataFrame, states: DataFrame, default_timeout_ms: int) -> DataFrame:
    """task_id, batch_date, state: READY, WAITING, FAILED or SKIPPED by the upstreams of a task and day.

    tasks: task_id, batch_date, rerun_id, waited_ms. deps: task_id, depends_on, action, timeout_ms,
    offset_days, ordinal. A wait over the limit fails before the upstream is looked at.
    """
    day = F.coalesce(F.date_add(F.try_to_date("batch_date", "yyyy-MM-dd"), F.coalesce("offset_days", F.lit(0))).cast("string"), F.col("batch_date"))
    rows = tasks.join(deps, "task_id").withColumn("_day", day)
    s = states.select(F.col("task_id").alias("depends_on"), F.col("batch_date").alias("_day"), "rerun_id", F.upper(F.trim("status")).alias("up"))
    rows = rows.join(s, ["depends_on", "_day", "rerun_id"], "left")
    action = F.upper(F.when(F.trim(F.coalesce("action", F.lit(""))) == "", "FAIL").otherwise(F.col("action")))
    verdict = (
        F.when(F.col("waited_ms") > F.greatest(F.lit(1000).cast("long"), F.coalesce("timeout_ms", F.lit(default_timeout_ms))), "FAILED")
        .when(F.col("up").isNull(), "WAITING")
        .when(F.col("up").isin("FAILED", "PARTIAL"), F.when(action == "SKIP", "SKIPPED").when(action != "IGNORE", "FAILED"))
        .when(F.col("up") != "SUCCESS", "WAITING")
    )
    first = rows.withColumn("verdict", verdict).filter("verdict IS NOT NULL").groupBy("task_id", "batch_date").agg(F.min_by("verdict", "ordinal").alias("verdict"))
    return tasks.join(first, ["task_id", "batch_date"], "left").select("task_id", "batch_date", F.coalesce("verdict", F.lit("READY")).alias("state"))
