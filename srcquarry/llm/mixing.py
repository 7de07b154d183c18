"""Records of several sources combined so that each source has its target share of the total size.

Low-discrepancy schedule. The mix is a sequence of slots of equal size in tokens. Slot i goes to the source
whose interval of cumulative weights holds the i-th golden-ratio point, so every stretch of the mix has
the shares of the whole. The weights are the sizes that the sources reach within their caps, so no source runs dry
before the end. Each source is a shuffled line of its documents, repeated in other orders as far
as its cap allows, cut into blocks of exactly the slot size (documents are split where a block ends, only the last
block of a source is shorter); the k-th slot of a source is joined with its k-th block, and slots are numbered without gaps.

No source is sorted or summed in one task: positions are prefix sums in two levels (hash ranges first).

Defined results: the total size is that of the documents of listed sources, each once; documents of no or
an unlisted source, and those without tokens (null or empty text), are not used; a source without
documents, or too small for its target within its cap, falls short and is reported so; shares are not
normalised; a document is used at most ``max_repeats`` times (null or less than one: never); repeated
rows of a document count once; a target named twice counts with the sum of its shares and its highest cap;
the last document of a source is taken if that brings its size closer to the target.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from srcquarry.llm.tokens import TOKENIZERS, VOCABULARY, encode_column
from srcquarry.runtime import Scratch

#: Tokens of a slot.
SLOT = 1024
#: Rows of a hash range, or of a stretch of slots, on average: prefix sums are taken within and over them.
RANGE_ROWS = 10_000
#: Sources a target table may name.
MOST_SOURCES = 10_000
GOLDEN = (math.sqrt(5) - 1) / 2


def sized(documents: DataFrame, targets: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, source, n_tokens) of the documents of listed sources, once each."""
    listed = documents.select("doc_id", "source", "text").join(targets.select("source").distinct(), "source", "left_semi")
    counts = encode_column(listed.filter("text is not null and text <> ''"), "doc_id", "text", "count", vocabulary)
    where = listed.select("doc_id", "source").groupBy("doc_id").agg(F.min("source").alias("source"))
    return where.join(counts.groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens")), "doc_id")


def running(df: DataFrame, by: list[str], part: Column, order: list[str], size: str, name: str) -> DataFrame:
    """``df`` with the sum of ``size`` over the rows of the same group before each row.

    Two levels: the totals of the parts (a number that grows with the order), summed over the parts of a group, plus
    a sum within the part.
    """
    parted = df.withColumn("__part", part)
    totals = parted.groupBy(*by, "__part").agg(F.sum(size).alias("__total"))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("__before", F.coalesce(F.sum("__total").over(before), F.lit(0))).drop("__total")
    inside = Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = parted.withColumn(name, F.coalesce(F.sum(size).over(inside), F.lit(0)))
    keys = [F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}")) for c in by] + [F.col("s.__part") == F.col("t.__part")]
    joined = summed.alias("s").join(totals.alias("t"), keys)
    return joined.select("s.*", (F.col(f"s.{name}") + F.col("t.__before")).alias("__sum")).drop("__part", name).withColumnRenamed("__sum", name)


class Mix:
    """``plan``: the part of a use of a document in each slot; ``shares``: what each source reached."""

    def __init__(self, documents: DataFrame, targets: DataFrame, slot: int = SLOT, vocabulary: str = f"{TOKENIZERS}/{VOCABULARY}"):
        spark = documents.sparkSession
        scratch = Scratch(spark, "mix")
        goal = targets.filter("source is not null").groupBy("source").agg(
            F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(0))).alias("max_repeats")
        )
        goal = scratch.write(goal, "goal")
        docs = scratch.write(sized(documents, goal, vocabulary).filter("n_tokens > 0"), "sized")
        have = docs.groupBy("source").agg(F.sum("n_tokens").alias("available"), F.count(F.lit(1)).alias("n_docs"))
        plan = goal.join(have, "source", "left").fillna(0, ["available", "n_docs"])
        # One number over all sources; the list of sources is the size of the target table.
        total = docs.agg(F.sum("n_tokens").alias("t")).first()["t"] or 0
        plan = plan.withColumn("total", F.lit(total).cast("long")).withColumn("target", F.col("target_share") * F.col("total"))
        plan = plan.withColumn("wanted", F.least("target", (F.col("available") * F.greatest("max_repeats", F.lit(0))).cast("double")))
        plan = plan.withColumn("epochs", F.when(F.col("available") > 0, F.ceil(F.col("wanted") / F.col("available"))).otherwise(0).cast("int"))
        self.goal = scratch.write(plan, "plan")

        uses = docs.join(self.goal.filter("epochs > 0").select("source", "available", "n_docs", "wanted", "epochs"), "source")
        uses = uses.withColumn("use", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
        uses = uses.withColumn("h", F.xxhash64("doc_id", "use"))
        ranges = F.ceil(F.col("n_docs") / RANGE_ROWS)
        uses = running(uses, ["source", "use"], F.floor((F.col("h") / F.lit(float(1 << 63)) + 1) / 2 * ranges), ["h", "doc_id"], "n_tokens", "start")
        uses = uses.withColumn("start", F.col("start") + F.col("use") * F.col("available"))
        uses = uses.filter(F.col("start") + F.col("n_tokens") / 2 <= F.col("wanted"))
        self.uses = scratch.write(uses.select("source", "doc_id", "use", "n_tokens", "start"), "uses")
        scratch.drop("sized", "goal")

        # Blocks of each source; a list of sources, as the target table has.
        rows = self.uses.groupBy("source").agg(F.max(F.col("start") + F.col("n_tokens")).alias("size")).orderBy("source").limit(MOST_SOURCES + 1).collect()
        if len(rows) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources in the target table")
        blocks = [-(-r["size"] // slot) for r in rows]
        n = sum(blocks)
        slots = self._slots(spark, [r["source"] for r in rows], blocks, n)
        edge = F.col("block") * slot
        pieces = self.uses.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / slot), F.floor((F.col("start") + F.col("n_tokens") - 1) / slot))))
        pieces = pieces.withColumn("from_token", F.greatest(edge - F.col("start"), F.lit(0)))
        pieces = pieces.withColumn("n_tokens", F.least("n_tokens", edge + slot - F.col("start")) - F.col("from_token"))
        self.plan = pieces.join(slots, ["source", "block"]).select(
            "slot", "source", "doc_id", (F.col("use") + 1).alias("use"), "from_token", "n_tokens", (F.col("start") + F.col("from_token") - edge).alias("offset_in_block")
        )

    @staticmethod
    def _slots(spark, names: list[str], blocks: list[int], n: int) -> DataFrame:
        """(source, block, slot): golden-ratio points through the cumulative weights, ranked per source, then numbered anew without gaps."""
        if not n:
            return spark.createDataFrame([], "source string, block bigint, slot bigint")
        highs = [sum(blocks[: k + 1]) / n for k in range(len(blocks))]
        # Rounding of the golden ratio may leave a source a few slots short: some more are laid out.
        laid = n + n // 16 + 64
        points = spark.range(laid).withColumn("u", ((F.col("id") + 0.5) * GOLDEN) % 1.0)
        at = F.least(F.size(F.filter(F.array(*map(F.lit, highs)), lambda h: h <= F.col("u"))), F.lit(len(names) - 1))
        points = points.select("id", at.alias("at"), F.lit(1).alias("one"))
        stretch = F.floor(F.col("id") / RANGE_ROWS)
        ranked = running(points, ["at"], stretch, ["id"], "one", "block").filter(F.col("block") < F.get(F.array(*map(F.lit, blocks)), F.col("at")))
        # Blocks that have no slot still (few, if any) follow at the end.
        have = {r["at"]: r["n"] for r in ranked.groupBy("at").agg(F.count(F.lit(1)).alias("n")).collect()}
        late = [(laid + b, k, b) for k, c in enumerate(blocks) for b in range(have.get(k, 0), c)]
        ranked = ranked.select("id", "at", "block")
        if late:
            ranked = ranked.unionByName(spark.createDataFrame(late, "id bigint, at int, block bigint"))
        dense = running(ranked.withColumn("one", F.lit(1)), [], stretch, ["id", "at"], "one", "slot")
        return dense.select(F.get(F.array(*map(F.lit, names)), F.col("at")).alias("source"), F.col("block").cast("long"), F.col("slot").cast("long"))

    def shares(self) -> DataFrame:
        used = self.uses.groupBy("source").agg(F.sum("n_tokens").alias("used"), F.max("use").alias("most"), F.count(F.lit(1)).alias("n_uses"))
        # A window over the rows of the target table, one per source.
        full = self.goal.join(used, "source", "left").withColumn("all_used", F.coalesce(F.sum("used").over(Window.partitionBy()), F.lit(0)))
        return full.select(
            "source", "target_share", "max_repeats", F.col("n_docs").alias("documents"), F.col("available").alias("available_tokens"),
            F.round("target").cast("long").alias("target_tokens"), F.coalesce("used", F.lit(0)).alias("used_tokens"),
            F.coalesce(F.col("most") + 1, F.lit(0)).alias("most_uses"), F.coalesce("n_uses", F.lit(0)).alias("uses"),
            F.when(F.col("total") > 0, F.coalesce("used", F.lit(0)) / F.col("total")).otherwise(0.0).alias("share_of_total"),
            F.when(F.col("all_used") > 0, F.coalesce("used", F.lit(0)) / F.col("all_used")).otherwise(0.0).alias("share_of_mix"),
        )
