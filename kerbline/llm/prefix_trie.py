"""The prefix trie of conversations, by collapsing whole sequences.

Every conversation becomes one 128-bit digest of its turns, each hashed with its place, so that a prefix's digest is
the exclusive-or of its turns and scans in parts. Identical conversations collapse into one weighted sequence with its
list of ends before any prefix is made; a conversation repeated a million times costs what one costs. Sequences that
are proper prefixes of others fall to an anti-join, which leaves the leaves; weighted prefixes are then aggregated,
combining on the map side, so the root or a first turn that everybody shares is no hot key.

Sums over subtrees need no walk: a node is represented by its smallest conversation, the nodes that one conversation
represents are a run of depths down to its end, and every descendant lies in exactly one such run. A subtree's sum is
the rest of the node's own run plus the whole runs of the other sequences that pass through it.

A conversation may hold any number of turns: scans along one go in chunks of ``CHUNK`` turns, carried by chunk totals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.llm.common import partitions
from kerbline.operators.running import running, sorted_chunks
from kerbline.scratch import Scratch

CHUNK, PIECE = 4096, 512
NODE = ["depth", "d1", "d2"]


def numbered(rows: DataFrame) -> DataFrame:
    """``conv_id, place, t1, t2, n_bytes``: the turns of each conversation, numbered from 0 in order of ``turn``.

    A null turn number comes first; equal ones are ordered by role, then by the text's digest. A null role or text is
    empty. Rows without a conversation id belong to no conversation and are left out. ``t1, t2`` identify the turn.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    half = lambda at: F.xxhash64(F.substring(whole, at, 32))
    t = rows.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        half(1).alias("t1"), half(33).alias("t2"), F.octet_length(text).cast("long").alias("n_bytes"), F.lit(1).cast("long").alias("_one"),
    )
    s = sorted_chunks(t, [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.col("t1"), F.col("t2")], "turns")
    r = running(s, ["conv_id"], "_chunk", ["_row"], {"_n": ("sum", "_one")})
    return r.select("conv_id", (F.col("_n") - 1).alias("place"), "t1", "t2", "n_bytes")


def _hashes() -> list[Column]:
    """Two hashes of a turn at its place; their exclusive-or over a prefix identifies the prefix."""
    return [F.xxhash64("place", "t1", "t2"), F.xxhash64(F.lit("second"), "t2", "place", "t1")]


def sequences(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """``conv_id, depth, d1, d2`` of each whole conversation of ``convs``; one without turns has depth 0."""
    a, b = _hashes()
    whole = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("depth"), F.bit_xor(a).alias("d1"), F.bit_xor(b).alias("d2"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return convs.select("conv_id").join(whole, "conv_id", "left").select("conv_id", *map(zero, NODE))


def _pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted ids of each sequence as joined texts of at most ``PIECE`` ids."""
    for f in frames:
        out = []
        for key, rows in groupby(zip(f["depth"], f["d1"], f["d2"], f["conv_id"], strict=True), key=lambda r: r[:3]):
            ids = [r[3] for r in rows]
            out += [(*key, ids[i], len(ids[i : i + PIECE]), ",".join(map(str, ids[i : i + PIECE]))) for i in range(0, len(ids), PIECE)]
        yield pd.DataFrame(out, columns=["depth", "d1", "d2", "rep", "n", "ids"])


def _hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each sequence from its pieces in order; the ids stream through the hash."""
    key, rep, weight, digest = None, None, 0, None
    for f in frames:
        out = []
        for *k, first, n, ids in f.itertuples(index=False, name=None):
            if k != key:
                if key is not None:
                    out.append((*key, rep, weight, digest.hexdigest()))
                key, rep, weight, digest = k, first, 0, hashlib.sha256()
            elif weight:
                digest.update(b",")
            digest.update(ids.encode())
            weight += n
        yield pd.DataFrame(out, columns=["depth", "d1", "d2", "rep", "weight", "ends_sha256"])
    if key is not None:
        yield pd.DataFrame([(*key, rep, weight, digest.hexdigest())], columns=["depth", "d1", "d2", "rep", "weight", "ends_sha256"])


def collapsed(whole: DataFrame, scratch: Scratch) -> DataFrame:
    """``depth, d1, d2, rep, weight, ends_sha256``: one row for each distinct sequence.

    ``rep`` is its smallest conversation, ``weight`` their number, ``ends_sha256`` the hash of all their ids in
    ascending order, joined by commas. Ids are sorted and joined by a range shuffle that splits a frequent sequence
    over tasks; the hash of one sequence, sequential by its nature, then runs over rows of ``PIECE`` ids.
    """
    n, order = partitions(whole), [*NODE, "conv_id"]
    pieces = whole.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order).mapInPandas(_pieces, "depth long, d1 long, d2 long, rep long, n long, ids string")
    by_key = pieces.repartition(n, *NODE).sortWithinPartitions(*NODE, "rep")
    return scratch.table(by_key.mapInPandas(_hashed, "depth long, d1 long, d2 long, rep long, weight long, ends_sha256 string"), "collapsed")


def prefixes(turns: DataFrame, seqs: DataFrame) -> DataFrame:
    """``rep, weight, length, depth, d1, d2, p1, p2, n_bytes``: every prefix of each distinct sequence, the empty one
    included; ``p1, p2`` is the prefix one turn shorter."""
    a, b = _hashes()
    mine = turns.join(seqs.select(F.col("rep").alias("conv_id")), "conv_id", "left_semi")
    mine = mine.select(F.col("conv_id").alias("rep"), "place", "n_bytes", a.alias("a"), b.alias("b"), F.expr(f"place div {CHUNK}").alias("chunk"))
    inside = Window.partitionBy("rep", "chunk").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("rep").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = mine.groupBy("rep", "chunk").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    carry = totals.select("rep", "chunk", *[F.coalesce(F.bit_xor(c).over(before), F.lit(0).cast("long")).alias(f"c{c}") for c in "ab"])
    scanned = mine.select("rep", "chunk", "place", "n_bytes", "a", "b", *[F.bit_xor(c).over(inside).alias(f"i{c}") for c in "ab"])
    d1, d2 = F.col("ia").bitwiseXOR(F.col("ca")), F.col("ib").bitwiseXOR(F.col("cb"))
    deep = scanned.join(carry, ["rep", "chunk"]).select(
        "rep", (F.col("place") + 1).alias("depth"), d1.alias("d1"), d2.alias("d2"), d1.bitwiseXOR(F.col("a")).alias("p1"), d2.bitwiseXOR(F.col("b")).alias("p2"), "n_bytes"
    )
    zero = F.lit(0).cast("long")
    root = seqs.select("rep", zero.alias("depth"), zero.alias("d1"), zero.alias("d2"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"), zero.alias("n_bytes"))
    return deep.union(root).join(seqs.select("rep", "weight", F.col("depth").alias("length")), "rep")


def _rest_of_run(nodes: DataFrame) -> DataFrame:
    """Adds ``rest``: ``saved`` of the node and of the deeper nodes with the same representative."""
    chunked = nodes.withColumn("chunk", F.expr(f"depth div {CHUNK}"))
    inside = Window.partitionBy("conv_id", "chunk").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("conv_id").orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    totals = chunked.groupBy("conv_id", "chunk").agg(F.sum("saved").alias("t"))
    carry = totals.select("conv_id", "chunk", F.coalesce(F.sum("t").over(after), F.lit(0).cast("long")).alias("later"))
    scanned = chunked.withColumn("_in", F.sum("saved").over(inside))
    return scanned.join(carry, ["conv_id", "chunk"]).withColumn("rest", F.col("_in") + F.col("later")).drop("chunk", "_in", "later")


def trie(turns: DataFrame, convs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """One row per node of the trie of ``convs`` (conv_id, distinct) with ``turns`` (conv_id, place from 0, t1, t2, n_bytes).

    ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``; the root has depth 0
    and no parent. Conversations without turns end at the root. No conversations: an empty table.
    """
    scratch = scratch or Scratch(turns.sparkSession, "trie")
    seqs = collapsed(sequences(turns, convs), scratch)
    p = scratch.table(prefixes(turns, seqs), "prefixes")
    inner = p.where(F.col("depth") < F.col("length")).select(*NODE).distinct()
    leaves = seqs.join(inner, NODE, "left_anti").select("rep", F.lit(1).cast("long").alias("leaf"))
    nodes = p.join(leaves, "rep", "left").groupBy(*NODE).agg(
        F.min("rep").alias("conv_id"), F.sum("weight").alias("n_convs"), F.count("leaf").alias("n_leaves"),
        F.min("n_bytes").alias("n_bytes"), F.min("p1").alias("p1"), F.min("p2").alias("p2"),
    )
    nodes = scratch.table(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("n_bytes")), "nodes")
    runs = scratch.table(nodes.groupBy("conv_id").agg(F.sum("saved").alias("run"), F.min("depth").alias("head")), "runs")
    through = p.join(runs.select(F.col("conv_id").alias("rep"), "run"), "rep").groupBy(*NODE).agg(F.sum("run").alias("runs"))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("d1"), F.col("p2").alias("d2")).agg(F.count(F.lit(1)).alias("n_children"))
    # within a run the parent is the run's own; only its first node has to look its parent up, one row for each sequence
    heads = nodes.join(runs.where("head > 0").select("conv_id", F.col("head").alias("depth")), ["conv_id", "depth"])
    heads = heads.select((F.col("depth") - 1).alias("depth"), F.col("p1").alias("d1"), F.col("p2").alias("d2"), F.col("conv_id").alias("child"))
    parents = heads.join(nodes.select(*NODE, "conv_id"), NODE).select(F.col("child").alias("conv_id"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("above"))
    out = _rest_of_run(nodes).join(runs, "conv_id").join(parents, ["conv_id", "depth"], "left")
    out = out.join(through, NODE).join(children, NODE, "left").join(seqs.select(*NODE, "ends_sha256"), NODE, "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "conv_id", "depth",
        F.when(F.col("depth") > F.col("head"), F.col("conv_id")).otherwise(F.col("above")).alias("parent_conv_id"),
        "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves",
        (F.col("rest") + F.col("runs") - F.col("run")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


# --- rebuilding -------------------------------------------------------------------------------

SPAN, HEADS = 5, 9


def rebuilt(rows: DataFrame, scratch: Scratch, span: int = SPAN, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """Turns and conversations of ``rows`` (conv_id, turn, role, text), each begun like the first of its ``span``.

    Conversation c takes the first h turns of conversation c - c % span (all if it has fewer, none if it is absent),
    then its own after its first h, with h the unsigned CRC-32 of c in decimal, modulo ``heads``.
    """
    t = scratch.table(numbered(rows), "numbered")
    cut = lambda c: (F.crc32(c.cast("string").cast("binary")) % heads).alias("h")
    lengths = scratch.table(t.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "lengths")
    convs = lengths.select("conv_id", cut(F.col("conv_id")), (F.col("conv_id") - F.col("conv_id") % span).alias("base"))
    given = convs.join(lengths.select(F.col("conv_id").alias("base"), "n"), "base", "left")
    given = scratch.table(given.select("conv_id", "base", "h", F.least("h", F.coalesce("n", F.lit(0).cast("long"))).alias("taken")), "convs")
    own = t.withColumn("h", cut(F.col("conv_id"))).where("place >= h").join(given.select("conv_id", "taken"), "conv_id")
    own = own.select("conv_id", (F.col("taken") + F.col("place") - F.col("h")).alias("place"), "t1", "t2", "n_bytes")
    # at most heads - 1 turns, each for at most span conversations
    first = t.where(F.col("place") < heads - 1).withColumnRenamed("conv_id", "base")
    lent = first.join(given, "base").where("place < h").select("conv_id", "place", "t1", "t2", "n_bytes")
    return scratch.table(own.union(lent), "rebuilt"), given.select("conv_id")
