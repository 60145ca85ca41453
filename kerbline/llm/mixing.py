"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source is cut into permuted blocks (ranges of a hash of its documents) and gets an exact quota of blocks:
whole passes over the source, and part of one more. A tree splits the quotas of all sources over the output
shards: at each node the left half's share of every source is a multivariate hypergeometric draw, so shards get
exact numbers of blocks in the proportions that one shuffle of all blocks would give, without shuffling them.
Shards then take disjoint runs of each source's permuted blocks, and order what they took locally.

Only one row per source and one per source and block (``BLOCKS`` at most for each source) is ever counted
together; documents are weighed in place.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.llm.common import literal_table, n_words
from kerbline.scratch import Scratch

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Blocks are the documents whose permuted order begins with the same hexadecimal digits.
DIGITS, BLOCKS = 3, 16**3
SEED = 20240501


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``, one row per source.

    Weights repeat over the sources in code point order, null last. Water filling: a target is the smaller of
    its source's limit and weight times a common level; sources ordered by limit per weight are full up to
    some place, and the level follows from what the others have to share.
    """
    ordered = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    s = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (ordered - 1) % len(weights) + 1))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("weight"))
    everything, fill = Window.partitionBy(), Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * F.lit(share)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    s = s.withColumn("level", level)
    # the level that holds is the first that the next source's limit does not undercut
    final = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source", "level"))).over(everything)["level"]
    return s.withColumn("final", final).select("source", "source_size", F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("final") * F.col("weight"))).alias("target"))


def split_quotas(quotas: list[int], leaves: int, seed: int = SEED) -> list[list[int]]:
    """Exact block counts by leaf and source; reruns agree. Leaves get totals at most one apart."""
    total = sum(quotas)
    rng = np.random.Generator(np.random.PCG64(seed))
    ends = [total * k // leaves for k in range(leaves + 1)]

    def split(node: np.ndarray, a: int, b: int) -> list[list[int]]:
        if b - a == 1:
            return [node.tolist()]
        mid = (a + b) // 2
        left = rng.multivariate_hypergeometric(node, ends[mid] - ends[a], method="marginals") if node.sum() else node
        return split(left, a, mid) + split(node - left, mid, b)

    return split(np.array(quotas, np.int64), 0, leaves)


def permuted(doc_id: Column, text: Column) -> Column:
    """The key of the permuted order within a source."""
    return F.md5(F.concat_ws(":", F.lit(str(SEED)), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))


def weighed(docs: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``doc_id, source, size, source_size, target, key, block, passes`` for every document.

    ``passes``: how often the mix takes it: the source's whole passes, and one more for the documents that come
    first in permuted order, up to the one that brings the sum nearest the rest of the target. Sums run over
    blocks; only the block in which a source's target ends is walked document by document.
    """
    d = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), permuted(F.col("doc_id"), F.col("text")).alias("key"))
    d = scratch.table(d.withColumn("block", F.substring("key", 1, DIGITS)), "weighed")
    blocks = d.groupBy("source", "block").agg(F.sum("size").alias("words"))
    t = targets(blocks.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    t = t.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    before = F.sum("words").over(Window.partitionBy("source").orderBy("block")) - F.col("words")
    b = blocks.withColumn("before", before).alias("b").join(t.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source")))
    state = F.when(F.col("before") + F.col("words") <= F.col("rest"), 1).when(F.col("before") >= F.col("rest"), 0)
    b = scratch.table(b.select("b.source", "block", "before", "source_size", "target", "whole", "rest", state.alias("state")), "blocks")
    j = d.alias("d").join(b.alias("b"), F.col("d.source").eqNullSafe(F.col("b.source")) & (F.col("d.block") == F.col("b.block")))
    j = j.select("doc_id", "d.source", "size", "key", "d.block", "before", "source_size", "target", "whole", "rest", "state")
    passes = lambda more: (F.col("whole") + more).cast("int").alias("passes")
    kept = ("doc_id", "source", "size", "source_size", "target", "key", "block")
    decided = j.where("state is not null").select(*kept, passes(F.col("state")))
    inside = F.sum("size").over(Window.partitionBy("source").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    walked = j.where("state is null").withColumn("up_to", F.col("before") + inside)
    walked = walked.select(*kept, passes(F.when(F.col("up_to") - F.col("size") / 2 <= F.col("rest"), 1).otherwise(0)))
    return decided.union(walked)


def dealt(chosen: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """``key, source, block, pass, shard, place`` for every time the mix takes a document (rows of
    ``weighed``): the block's shard by the splitting tree, and the order within the shard.

    One row per source reaches the driver, with its number of blocks, and the tree's answer, one row per
    source with a number for each shard, goes back.
    """
    taken = chosen.where("passes > 0").select("key", "source", "block", F.explode(F.sequence(F.lit(1), "passes")).alias("pass"))
    blocks = taken.groupBy("source", "pass", "block").agg(F.count(F.lit(1)).alias("rows"))
    order = F.row_number().over(Window.partitionBy("source").orderBy("pass", "block")) - 1
    blocks = blocks.withColumn("order", order)
    quota = blocks.groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy("source").collect()
    leaves = split_quotas([r["n"] for r in quota], shards, seed)
    ends = [(r["source"], [int(x) for x in np.cumsum([leaf[i] for leaf in leaves])]) for i, r in enumerate(quota)]
    tree = literal_table(chosen.sparkSession, ends, "source string, ends array<long>").alias("t")
    b = blocks.alias("b").join(tree, F.col("b.source").eqNullSafe(F.col("t.source")))
    b = b.select("b.source", "pass", "block", F.size(F.filter("ends", lambda e: e <= F.col("order"))).alias("shard")).alias("b")
    j = taken.alias("k").join(b, F.col("k.source").eqNullSafe(F.col("b.source")) & (F.col("k.pass") == F.col("b.pass")) & (F.col("k.block") == F.col("b.block")))
    return j.select("key", "k.source", "k.block", "k.pass", "shard", F.xxhash64(F.lit(seed), "shard", "key", "k.pass").alias("place"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds ``n``, a number from 0 among the rows of one ``source, key``, and ``of``, how many they are: rows
    alike in id, text and source share a key, and each takes its own part of the key's places."""
    n = F.row_number().over(Window.partitionBy("source", "key").orderBy("key")) - 1
    return rows.withColumn("n", n).withColumn("of", F.count(F.lit(1)).over(Window.partitionBy("source", "key")))


def mix(docs: DataFrame, scratch: Scratch | None = None, shards: int | None = None, **settings: object) -> DataFrame:
    """The mix itself: the rows of ``docs`` as often as they are taken, in ``shards`` shuffled partitions
    (by default the session's shuffle partitions), with all columns as they were.

    A null text has size 0 and is taken as often as its place in the permuted order says. Rows alike in id,
    text and source are interchangeable: as many copies go as their counts say.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "mixing")
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    chosen = scratch.table(weighed(docs, scratch, **settings), "chosen")
    places = dealt(chosen, shards).groupBy("source", "key").agg(F.collect_list(F.struct("shard", "place")).alias("at")).alias("p")
    distinct = chosen.groupBy("source", "key").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").isEmpty()
    d = docs.select(F.struct("*").alias("row"), F.col("source").alias("source"), permuted(F.col("doc_id"), F.col("text")).alias("key"))
    # whole rows are only dealt anew for the numbers if some repeat
    d = (d.withColumn("n", F.lit(0)).withColumn("of", F.lit(1)) if distinct else _numbered(d)).alias("d")
    j = d.join(places, F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.key") == F.col("p.key")))
    own = F.filter("at", lambda x, i: i % F.col("of") == F.col("n"))
    out = j.select("row", F.explode(own).alias("to")).select("row", "to.shard", "to.place")
    return out.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "place").select("row.*")


def taken_words(docs: DataFrame, scratch: Scratch | None = None, shards: int | None = None, **settings: object) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every document (doc_id, source, text).

    ``taken`` counts repeats: a document's size for each time that the splitting tree deals it to a shard, as in
    ``mix``. No document is taken more than ``most`` times; a source's sum differs from its
    target by at most half of one document. Null sources are one source, the last. No rows: an empty table.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "mixing")
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    chosen = scratch.table(weighed(docs, scratch, **settings), "chosen")
    times = dealt(chosen, shards).groupBy("source", "key").agg(F.count(F.lit(1)).alias("times")).alias("t")
    c = _numbered(chosen).alias("c")
    j = c.join(times, F.col("c.source").eqNullSafe(F.col("t.source")) & (F.col("c.key") == F.col("t.key")), "left")
    own = F.floor((F.coalesce("times", F.lit(0)) + F.col("of") - 1 - F.col("n")) / F.col("of"))
    return j.select("doc_id", "size", "source_size", "target", (F.col("size") * own).alias("taken"))
