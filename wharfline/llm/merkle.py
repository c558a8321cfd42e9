"""A Merkle manifest of a dataset: a hash tree for each source, and one over the sources.

Leaves get their place by a range sort that is written once: a row's place is that in its part plus the rows of
the source in parts before. Each level is one aggregation: conditional aggregates spread a parent's children into
``fanout`` columns, whose concatenation is hashed. Leaving out a child's own column gives its siblings, so
proofs go down the same tables, each child adding its siblings to what its parent has.

Neither a source nor a level has to fit a task; only tables of parts and of sources are windowed.

Cases: null fields are hashed as ``-`` and differ from empty ones; a null source is a source of its own, the first; rows
with equal or null ids are leaves of their own (nulls first, then by digest); rows without an id aren't tampered with;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wharfline.llm.workdir import Scratch, materialize, shuffle_partitions

FANOUT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest_of(*values: Column) -> Column:
    """SHA-256 of the fields, each with its length in front, so that no two rows read alike."""
    field = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*(field(v.cast("string")) for v in values)).cast("binary"), 256)


def leaves(docs: DataFrame, tamper: Column | None = None) -> DataFrame:
    """doc_id, source, leaf, and ``tampered``: the leaf after the text has become ``tamper``."""
    rest = [F.col(c) for c in FIELDS[:-1]]
    leaf = digest_of(*rest, F.col("text"))
    changed = leaf if tamper is None else F.when(tamper.eqNullSafe(F.col("text")), leaf).otherwise(digest_of(*rest, tamper))
    return docs.select("doc_id", "source", leaf.alias("leaf"), changed.alias("tampered"))


def numbered(scratch: Scratch, rows: DataFrame, group: str, *order: str) -> DataFrame:
    """Rows with ``tree``, a number of their group, their place in it from 0, and its size."""
    ranged = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), group, *order).sortWithinPartitions(group, *order)
    rows = scratch.table(ranged.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    # a group has a row for each part that it lies in
    whole = Window.partitionBy("of")
    runs = rows.groupBy(F.col("part").alias("p"), F.col(group).alias("of")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    start = F.sum("n").over(whole.orderBy("p")) - F.col("n")
    runs = scratch.table(runs.select("p", "of", "first", start.alias("start"), F.sum("n").over(whole).alias("size"), F.min("first").over(whole).alias("tree")))
    both = rows.join(runs, (F.col("part") == F.col("p")) & F.col(group).eqNullSafe(F.col("of")))
    return both.select(*(c for c in rows.columns if c not in ("part", "at")), "tree", (F.col("start") + F.col("at") - F.col("first")).alias("pos"), "size")


def _up(size: Column | str, fanout: int) -> Column:
    return F.ceil(F.col(size) / fanout) if isinstance(size, str) else F.ceil(size / fanout)


def climb(scratch: Scratch, nodes: DataFrame, fanout: int = FANOUT) -> tuple[list[DataFrame], DataFrame]:
    """(levels, roots) of trees given by tree, pos, size, digest and further columns of the leaves.

    A level has a row for each parent: tree, pos, size (of the level below) and the children c0, c1, ..., as structs.
    """
    nodes = scratch.table(nodes)
    most = nodes.agg(F.coalesce(F.max("size"), F.lit(0)).alias("most")).first().most
    levels, roots = [], [nodes.filter("size = 1").select("tree", "digest")]
    while most > 1:
        child = F.struct(*(c for c in nodes.columns if c not in ("tree", "pos", "size")))
        columns = [F.max(F.when(F.col("pos") % fanout == k, child)).alias(f"c{k}") for k in range(fanout)]
        parents = nodes.filter("size > 1").groupBy("tree", F.floor(F.col("pos") / fanout).alias("pos"), "size").agg(*columns)
        levels.append(scratch.table(parents))
        joined = F.concat_ws("", *(F.col(f"c{k}.digest") for k in range(fanout)))
        nodes = levels[-1].select("tree", "pos", _up("size", fanout).alias("size"), F.sha2(joined.cast("binary"), 256).alias("digest"))
        roots.append(nodes.filter("size = 1").select("tree", "digest"))
        most = -(-most // fanout)
    return levels, reduce(DataFrame.unionByName, roots)


def descend(levels: list[DataFrame], tops: DataFrame, alone: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The leaves' columns with their proofs: siblings to the left and right, level by level up to the top.

    tops: tree, proof (of the root, in a tree above) and what else each tree's leaves are to get; alone: leaves that are
    roots. The proofs pass from level to level in one plan.
    """
    extra = [c for c in tops.columns if c != "tree"]
    above, steps = None, None
    for level in reversed(levels):
        # a parent is its tree's root, or has its proof from the level above
        root = level.filter(F.col("size") <= fanout).join(tops, "tree")
        if above is None:
            steps = root
        else:
            inner = level.filter(F.col("size") > fanout).join(above.select("tree", "pos", *extra), ["tree", "pos"])
            steps = root.unionByName(inner)
        texts = [F.coalesce(F.col(f"c{k}.digest"), F.lit("")) for k in range(fanout)]
        children = F.array(*(
            F.struct((F.col("pos") * fanout + k).alias("pos"), F.col(f"c{k}").alias("node"), F.concat_ws("", *texts[:k]).alias("left"), F.concat_ws("", *texts[k + 1:]).alias("right"))
            for k in range(fanout)
        ))
        rows = steps.select("tree", *extra, F.explode(F.filter(children, lambda c: c["node"].isNotNull())).alias("child"))
        step = F.array(F.struct(F.col("child.left").alias("left"), F.col("child.right").alias("right")))
        others = [c for c in extra if c != "proof"]
        above = rows.select("tree", F.col("child.pos").alias("pos"), *others, F.concat(step, F.col("proof")).alias("proof"), "child.node.*")
    lone = alone.join(tops, "tree").drop("size")
    return lone if above is None else above.unionByName(lone)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(proof, leaf, lambda now, step: F.sha2(F.concat(step["left"], now, step["right"]).cast("binary"), 256))


def manifest(docs: DataFrame, tamper: Column | None = None, fanout: int = FANOUT) -> DataFrame:
    """doc_id, leaf, tampered, subroot, root and proof (array of left and right siblings) of each row.

    tamper: what a row's text becomes for ``tampered``.
    """
    spark = docs.sparkSession
    with Scratch(spark, "merkle") as scratch:
        # digests first, so that texts are hashed once and never sorted
        rows = scratch.table(leaves(docs, tamper))
        placed = scratch.table(numbered(scratch, rows, "source", "doc_id", "leaf"))
        nodes = placed.select("tree", "pos", "size", F.col("leaf").alias("digest"), "doc_id", "tampered")
        levels, subroots = climb(scratch, nodes, fanout)
        sources = placed.filter("pos = 0").select("tree", "source").join(subroots, "tree")
        sources = numbered(scratch, sources.select(F.col("tree").alias("of_source"), "source", "digest", F.lit(0).alias("all")), "all", "source")
        sources = scratch.table(sources.select("tree", "pos", "size", "digest", "of_source"))
        upper, root = climb(scratch, sources, fanout)
        top = root.select("tree", F.array().cast("array<struct<left:string,right:string>>").alias("proof"), F.col("digest").alias("root"))
        tops = descend(upper, top, sources.filter("size = 1"), fanout)
        tops = scratch.table(tops.select(F.col("of_source").alias("tree"), "proof", F.col("digest").alias("subroot"), "root"))
        found = descend(levels, tops, nodes.filter("size = 1"), fanout)
        return materialize(spark, found.select("doc_id", F.col("digest").alias("leaf"), "tampered", "subroot", "root", "proof"), "merkle")


def without_newlines() -> Column:
    """The text without its line feeds, for rows whose id has an even checksum."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(F.coalesce(even, F.lit(False)), F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


def manifest_report(docs: DataFrame) -> DataFrame:
    """One row for each document: its digests, its proof's digest, and whether its tampered text is found out."""
    rows = manifest(docs, without_newlines())
    siblings = F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), "")
    rows = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"), folded(F.col("tampered"), F.col("proof")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
