"""Parent-child rows of unknown depth to full hierarchies (level-wise frontier joins).

Results for odd input, covered by ``tests/test_hierarchy.py``:

* a row with one null end links nothing, but its other end is a node; repeated rows count once; an empty
  table gives an empty result;
* a child with several parents hangs under its smallest parent id (``extra_parents`` lists the others);
* a node that no root reaches lies on a loop or below one: ``root = ''``, ``depth = -1``, no path;
* ids are opaque: the empty string is an id like any other, nothing is trimmed;
* extra columns of the input are ignored, so names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from srcquarry.runtime import Scratch

#: Consumed edges are dropped from the working set once they are this share of it.
PRUNE_SHARE = 0.5
#: Levels taken one at a time before several are taken in one join.
SINGLE = 3
#: Levels of one join at most; the table for it may have so many times the rows of all links.
MOST_LEVELS, ROOM = 32, 2
#: Links of a partition, as long as there are no more than so many partitions.
PARTITION_LINKS, MOST_PARTITIONS = 25_000, 20_000
#: Links a parent has at least before it counts as one with more than its share.
HOT_LINKS = 10_000


def contains_edges(edges: DataFrame, edge_type: str = "CONTAINS") -> DataFrame:
    """(parent, child) of the edges of one type, ignoring case and white space around it (repeated rows stay: the
    operators below count them once, in the aggregate they need anyway)."""
    kind = F.upper(F.regexp_replace("edge_type", r"^\s+|\s+$", ""))
    return (
        edges.filter(kind == edge_type)
        .select(F.col("caller_symbol_id").alias("parent"), F.col("callee_symbol_id").alias("child"))
        .filter(F.col("parent").isNotNull() | F.col("child").isNotNull())
    )


def _linked(links: DataFrame) -> DataFrame:
    """Links with both ends, one parent per child."""
    both = links.filter(F.col("parent").isNotNull() & F.col("child").isNotNull())
    return both.groupBy("child").agg(F.min("parent").alias("parent"))


def extra_parents(links: DataFrame) -> DataFrame:
    """(child, parent) links beyond the one kept per child."""
    kept = _linked(links).withColumnRenamed("parent", "kept")
    return links.join(kept, "child").filter("parent <> kept").select("child", "parent").distinct()


def _doubled(reach: DataFrame, span: int, keep_path: bool) -> DataFrame:
    """The table of all ways of up to ``span`` links, as (parent, child, distance[, way]), extended to twice as many."""
    first = reach.filter(F.col("distance") == span).select("parent", F.col("child").alias("mid"), *([F.col("way").alias("start")] if keep_path else []))
    then = reach.withColumnRenamed("parent", "mid").withColumnRenamed("distance", "more")
    way = [F.concat("start", "way").alias("way")] if keep_path else []
    return reach.unionByName(first.join(then, "mid").select("parent", "child", (F.col("more") + span).alias("distance"), *way))


def _partitions(links: int) -> int:
    """Partitions for so many links: by their number, not by the size of the cluster, so that small ones take few tasks."""
    return max(1, min(MOST_PARTITIONS, -(-links // PARTITION_LINKS)))


def hierarchy(links: DataFrame, keep_path: bool = False) -> DataFrame:
    """(symbol_id, root_symbol_id, depth[, path array]) for every id in (parent, child) ``links``.

    The links are reduced to one parent per child, hash-partitioned by parent and kept; the frontier is joined with them level
    by level (a merge join that shuffles only the frontier) and each level is written to the shared folder, which cuts the lineage.
    Links are dropped from the working set once used. Deep trees have narrow levels: after SINGLE levels the
    links left are squared to a table of the ways of up to 2, 4, 8 ... links, as far as it stays within ROOM times
    all links, and one join takes that many levels; each node still comes once, by its one way from the frontier.

    A parent with more than its share of all links (there can be at most twice as many such parents as
    partitions) would make one partition of them all: its links stay spread as they are and take no part in the squaring, and
    the few frontier rows of such parents, bounded by that number, are broadcast to them.
    """
    spark = links.sparkSession
    scratch = Scratch(spark, "hierarchy")
    # All rows that name a node: those with a null end or a parent that is not taken keep nodes that nothing links.
    named = scratch.write(links.select("child", "parent").filter("child is not null or parent is not null"), "named")
    one, left = scratch.write_counted(_linked(named), "links")
    n = _partitions(left)

    nodes = named.filter("child is not null").select(F.col("child").alias("symbol_id"), F.col("parent").isNotNull().cast("int").alias("is_child"))
    nodes = nodes.unionByName(named.filter("parent is not null").select(F.col("parent").alias("symbol_id"), F.lit(0).alias("is_child")))
    nodes = nodes.groupBy("symbol_id").agg(F.max("is_child").alias("is_child"))
    roots = nodes.filter("is_child = 0").select(
        "symbol_id", F.col("symbol_id").alias("root_symbol_id"), F.lit(0).alias("depth")
    )
    if keep_path:
        roots = roots.withColumn("path", F.array("symbol_id"))
    schema = roots.schema
    frontier, size = scratch.write_counted(roots, "level/l=0")

    # Sizes are known and hot parents are apart, so the levels are planned once, not anew after each of their shuffles.
    loop = scratch.within(spark.newSession())
    for name, value in (("adaptive.enabled", "false"), ("shuffle.partitions", n)):
        loop.spark.conf.set(f"spark.sql.{name}", value)
    one, frontier = loop.read("links", one.schema), loop.read("level/l=0", schema)

    def keep(df: DataFrame, rows: int) -> DataFrame:
        return df.repartition(_partitions(rows), "parent").sortWithinPartitions("parent").persist()

    def squared(live: DataFrame, rows: int) -> tuple[DataFrame, int]:
        """(table of ways, their greatest length) of the links left."""
        way = [F.array("child").alias("way")] if keep_path else []
        reach, span = keep(live.select("parent", "child", F.lit(1).alias("distance"), *way), rows), 1
        while span < MOST_LEVELS and level >= SINGLE and 2 * span * rows <= ROOM * total:
            more = keep(_doubled(reach, span, keep_path), 2 * span * rows)
            more.count()
            reach.unpersist()
            reach, span = more, 2 * span
        return reach, span

    share = max(HOT_LINKS, left // (2 * n))
    hot, n_hot = loop.write_counted(one.groupBy("parent").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > share).select("parent"), "hot")
    wide = one.join(F.broadcast(hot), "parent", "left_semi").persist() if n_hot else None
    live = one.join(F.broadcast(hot), "parent", "left_anti") if n_hot else one
    total, used, level, turn, path = left, 0, 0, 0, ["path"] if keep_path else []
    reach, span = squared(live, left)
    fresh = ["symbol_id", "root_symbol_id", "depth", *path]
    while size and left:
        way = [F.concat("path", "way").alias("path")] if keep_path else []
        rows = frontier.withColumnRenamed("symbol_id", "parent").join(reach, "parent").select(
            F.col("child").alias("symbol_id"), "root_symbol_id", (F.col("depth") + F.col("distance")).alias("depth"), *way, (F.col("distance") == span).alias("open")
        )
        if n_hot:
            few = frontier.join(F.broadcast(hot.withColumnRenamed("parent", "symbol_id")), "symbol_id", "left_semi").limit(n_hot)
            way = [F.concat("path", F.array("child")).alias("path")] if keep_path else []
            below = F.broadcast(few.withColumnRenamed("symbol_id", "parent")).join(wide, "parent")
            rows = rows.unionByName(below.select(F.col("child").alias("symbol_id"), "root_symbol_id", (F.col("depth") + 1).alias("depth"), *way, F.lit(True).alias("open")))
            # The ways of the table end at such parents: they wait for their turn whatever their distance.
            rows = rows.join(F.broadcast(hot.select(F.col("parent").alias("symbol_id"), F.lit(True).alias("hot"))), "symbol_id", "left")
            rows = rows.select(*fresh, (F.col("open") | F.coalesce("hot", F.lit(False))).alias("open"))
        turn += 1
        new, seen = loop.write_observed(rows, f"level/l={turn}", n=F.count(F.lit(1)), open=F.count_if(F.col("open")))
        frontier, size = new.filter("open").select(*fresh), seen["open"]
        used, level = used + seen["n"], level + span
        if size and (used >= PRUNE_SHARE * left or (level >= SINGLE and span == 1 and 2 * left <= ROOM * total)):
            gone = loop.read("level", schema).drop("l").select(F.col("symbol_id").alias("child"))
            live, left = loop.write_counted(live.join(gone, "child", "left_anti"), f"left/{turn}")
            reach.unpersist()
            reach, span = squared(live, left)
            left, used = left + n_hot, 0
    reach.unpersist()
    if wide is not None:
        wide.unpersist()
    scratch.drop("links", "hot", "left")
    reached = scratch.read("level", schema).drop("l")
    lost = nodes.select("symbol_id").join(reached.select("symbol_id"), "symbol_id", "left_anti")
    lost = lost.select("symbol_id", F.lit("").alias("root_symbol_id"), F.lit(-1).alias("depth"))
    if keep_path:
        lost = lost.withColumn("path", F.array().cast("array<string>"))
    return reached.unionByName(lost)


def descendants(tree: DataFrame) -> DataFrame:
    """(ancestor_id, symbol_id, distance) from the paths of ``hierarchy(keep_path=True)``.

    Every pair comes once: the paths hold each ancestor at its position, so no further join is needed.
    """
    at = tree.filter("depth > 0").select("symbol_id", "depth", F.posexplode("path").alias("pos", "ancestor_id"))
    return at.filter("pos < depth").select("ancestor_id", "symbol_id", (F.col("depth") - F.col("pos")).alias("distance"))


def loops(links: DataFrame, tree: DataFrame) -> DataFrame:
    """(symbol_id, loop_id) of the nodes that lie on a loop themselves; ``loop_id`` is its smallest id.

    Among the unreached nodes everything that only hangs below a loop is peeled off leaf by leaf (the
    nodes left have a child among those left); the rest are loops, labelled by repeated pointer squaring.
    """
    spark = links.sparkSession
    scratch = Scratch(spark, "loops")
    one = _linked(links)
    lost = tree.filter("depth = -1").select(F.col("symbol_id").alias("child"))
    (rest, size), k = scratch.write_counted(one.join(lost, "child", "left_semi"), "rest/0"), 0
    while size:
        smaller = rest.join(rest.select(F.col("parent").alias("child")).distinct(), "child", "left_semi")
        k += 1
        rest, left = scratch.write_counted(smaller, f"rest/{k}")
        if left == size:
            break
        size = left
    # Every node left has exactly one successor and one predecessor: square the successor table.
    ring, k = rest.select("child", F.col("parent").alias("to"), F.least("child", "parent").alias("low")), 0
    ring = scratch.write(ring, "ring/0")
    while (1 << k) < max(1, size):
        nxt = ring.select(F.col("child").alias("to"), F.col("to").alias("to2"), F.col("low").alias("low2"))
        k += 1
        new = ring.join(nxt, "to").select("child", F.col("to2").alias("to"), F.least("low", "low2").alias("low"))
        new = scratch.write(new, f"ring/{k}")
        same = new.join(ring.select("child", F.col("low").alias("old")), "child").filter("low <> old").isEmpty()
        ring = new
        if same:
            break
    return ring.select(F.col("child").alias("symbol_id"), F.col("low").alias("loop_id"))
