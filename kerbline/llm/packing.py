"""Best-fit packing of tokenised documents into sequences of fixed length, in bulk-synchronous rounds.

Waiting pieces and the gaps of open sequences are rows. A round sorts both by size and sweeps from large to small:
each piece takes the smallest gap that holds it and that no larger piece took. On the sorted line this is the
matching of brackets, a gap opening one and a piece closing one: the piece closes the last gap still open. A bracket's
level is a count of gaps less pieces before it, which the sizes' counts (at most two per size, so bounded by the
sequence length) and the rank within its size give. So rows of one level meet in a shuffle, where gap and piece
follow each other; one level holds at most one gap and one piece of each size. Taken gaps shrink, and the
next round begins.

Pieces come in classes from large to small; class q are those of which q and no more fit a sequence. Once no gap
holds a piece of the class, the rest of the class opens sequences, q in each, as best-fit decreasing would. Short
pieces (under a 17th of a sequence) come last, as runs of pieces of one length that are halved while no gap holds them,
after as many sequences were opened as their tokens certainly need. Rounds are bounded by the sequence
length, not by the rows; each writes its tables, and only counts by size reach the driver. Tests hold the number of
sequences against best-fit decreasing on adverse sizes (at most 1 % more).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.llm.common import literal_table
from kerbline.scratch import Scratch

CAPACITY, END_ID = 1024, 2
#: Rows of one size that one task numbers, about.
PART_ROWS = 1 << 18
#: Classes that are swept together, and the largest class; longer runs of shorter pieces follow.
CLASSES, LAST = [(1, 1), (2, 2), (3, 3), (4, 4), (5, 6), (7, 10), (11, 16)], 16
#: Rows of a round: open gaps, waiting runs of ``n`` pieces of one length from rank ``first`` on, and placed runs.
GAP, WAITING, PLACED = 0, 1, 2
STATE = "kind int, size int, length int, first long, n int, sequence long, offset int"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: The special token of the byte-level vocabulary; its ranks file leaves this id free.
SPECIAL = {"<|endoftext|>": 50256}


def tokenizer(vocabulary: bytes, ranks: bool):
    """Encoder for a byte-level vocabulary, the content of a file of ranks (``.tiktoken``) or of a ``tokenizers`` file;
    both give the same ids for the same vocabulary, the former several times as fast. The special token's string in a
    text becomes its id, as the library does it by default."""
    if ranks:
        import base64

        import public_tokenizers
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        byte_bpe = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=SPECIAL)
        every = set(SPECIAL)
        return lambda text: byte_bpe.encode(text, allowed_special=every)
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(vocabulary.decode())
    return lambda text: t.encode(text, add_special_tokens=False).ids


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of a document's pieces: whole sequences, and what is left over in front."""
    first = n % capacity
    starts = ([0] if first else []) + list(range(first, n, capacity))
    return [(s, e - s) for s, e in zip(starts, starts[1:] + [n], strict=True)]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of documents (doc_id, text), tokenised whole.

    The vocabulary is read here and travels with the tasks, so executors need no copy of its file.
    """
    with open(path, "rb") as f:
        vocabulary = f.read()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokenizer(vocabulary, path.endswith(".tiktoken"))
        for f in frames:
            out = []
            for i, text in zip(f["doc_id"], f["text"], strict=True):
                ids = np.array([*encode(text or ""), END_ID], "<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    out.append((None if pd.isna(i) else int(i), k, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(run, PIECES)


def ranked(items: DataFrame, group: list[str], order: list[Column], salts: int = 1) -> DataFrame:
    """Adds ``rank`` from 0 within a group.

    A group may hold most rows, so each is numbered in ``salts`` parts; a part starts where the ones before
    it end, by a table of groups times salts.
    """
    if salts == 1:
        return items.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - F.lit(1).cast("long"))
    salted = items.withColumn("salt", F.pmod(F.xxhash64(*items.columns), F.lit(salts)).cast("int"))
    before = F.sum("count").over(Window.partitionBy(*group).orderBy("salt")) - F.col("count")
    starts = salted.groupBy(*group, "salt").count().select(*group, "salt", before.alias("before"))
    inner = F.row_number().over(Window.partitionBy(*group, "salt").orderBy(*order))
    return salted.withColumn("inner", inner - 1).join(starts, [*group, "salt"]).withColumn("rank", F.col("inner") + F.col("before")).drop("salt", "before", "inner")


class Rounds:
    """The rounds over a table of ``length, rank`` (ranks from 0 within a length, all lengths below the capacity)."""

    def __init__(self, numbered: DataFrame, counts: dict[int, int], capacity: int, scratch: Scratch):
        self.spark, self.numbered, self.counts, self.capacity, self.scratch = numbered.sparkSession, numbered, counts, capacity, scratch
        self.state = self.spark.range(0).select([F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in STATE.split(", ")])
        self.paths: list[str] = []
        self.made = 0

    def run(self) -> DataFrame:
        """``length, rank, sequence, offset`` of every piece."""
        for low, high in CLASSES:
            shortest, longest = self.capacity // (high + 1) + 1, self.capacity // low
            if any(shortest <= length <= longest for length in self.counts):
                one = self.numbered.where(F.col("length").between(shortest, longest))
                self.add(one.select("length", F.col("rank").alias("first"), F.lit(1).alias("n")))
                while not self.finish_class():
                    pass
        self.fill()
        if not self.paths:
            return self.numbered.select("length", "rank", F.lit(0).cast("long").alias("sequence"), F.lit(0).alias("offset")).limit(0)
        placed = self.spark.read.schema(STATE).parquet(*self.paths).where(F.col("kind") == PLACED)
        each = placed.select("length", "first", "sequence", "offset", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
        return each.select("length", (F.col("first") + F.col("k")).alias("rank"), "sequence", (F.col("offset") + F.col("k") * F.col("length")).alias("offset"))

    def keep(self, state: DataFrame) -> None:
        back = self.scratch.table(state.select([F.col(f.name).cast(f.dataType) for f in self.state.schema]), "round")
        self.paths.append(back._scratch_path)
        self.state = back.where(F.col("kind") != PLACED)

    def add(self, runs: DataFrame) -> None:
        """Runs (length, first, n) that wait from now on."""
        none = F.lit(None)
        rows = runs.select(F.lit(WAITING).alias("kind"), (F.col("n") * F.col("length")).alias("size"), "length", "first", "n", none.cast("long").alias("sequence"), none.cast("int").alias("offset"))
        self.state = self.state.select([F.col(f.name) for f in self.state.schema]).unionByName(rows)

    def sizes(self) -> tuple[dict[int, int], dict[int, int]]:
        """Counts of gaps and of waiting runs by size; at most two rows a size."""
        found: tuple[dict[int, int], dict[int, int]] = ({}, {})
        for r in self.state.groupBy("kind", "size").count().collect():
            found[r["kind"]][r["size"]] = r["count"]
        return found

    def finish_class(self) -> bool:
        """One round for the waiting pieces of a class: meet gaps, or open sequences where no gap holds any of them."""
        gaps, waiting = self.sizes()
        if waiting and max(gaps, default=0) >= min(waiting):
            self.sweep(gaps, waiting)
            return False
        if waiting:
            self.open_class(waiting)
        return True

    def sweep(self, gaps: dict[int, int], waiting: dict[int, int]) -> None:
        """Each waiting run takes the smallest gap that holds it and that no larger run took."""
        least = min(waiting)
        depth, bases = 0, []  # the level that the first gap opens, and the one that the first run closes, of each size
        for size in sorted({g for g in gaps if g >= least} | set(waiting), reverse=True):
            bases.append((size, GAP, depth))
            depth += gaps.get(size, 0)
            bases.append((size, WAITING, depth - 1))
            depth -= waiting.get(size, 0)
        base = F.broadcast(literal_table(self.spark, bases, "size int, kind int, base long"))  # at most two rows a size
        salts = -(-max([*gaps.values(), *waiting.values()]) // PART_ROWS)
        met = (F.col("kind") == WAITING) | (F.col("size") >= least)
        rows = ranked(self.state.where(met), ["kind", "size"], [F.desc("length"), F.asc("first"), F.asc("sequence")], salts)
        level = F.col("base") + F.when(F.col("kind") == GAP, F.col("rank")).otherwise(-F.col("rank"))
        order = Window.partitionBy("level").orderBy(F.desc("size"), "kind")
        pair = F.struct("kind", "size", "sequence")
        seen = rows.join(base, ["size", "kind"]).withColumn("level", level).withColumn("above", F.lag(pair).over(order)).withColumn("below", F.lead(pair).over(order))
        taken = (F.col("kind") == GAP) & (F.col("below.kind") == WAITING)
        fits = (F.col("kind") == WAITING) & (F.col("above.kind") == GAP)
        after = seen.select(
            F.when(fits, PLACED).otherwise(F.col("kind")).alias("kind"),
            F.when(taken, F.col("size") - F.col("below.size")).otherwise(F.col("size")).alias("size"),
            "length", "first", "n",
            F.when(fits, F.col("above.sequence")).otherwise(F.col("sequence")).alias("sequence"),
            F.when(fits, self.capacity - F.col("above.size")).alias("offset"),
        )
        self.keep(after.where((F.col("kind") != GAP) | (F.col("size") > 0)).unionByName(self.state.where(~met)))

    def open_class(self, waiting: dict[int, int]) -> None:
        """All waiting pieces open sequences: of class q, q in each, from the largest on."""
        base, above, starts = [], {}, {}
        for size in sorted(waiting, reverse=True):
            q = self.capacity // size
            base.append((size, q, above.get(q, 0)))
            above[q] = above.get(q, 0) + waiting[size]
        for q, n in sorted(above.items()):
            starts[q] = self.made
            self.made += -(-n // q)
        table = F.broadcast(literal_table(self.spark, [(s, q, b, starts[q]) for s, q, b in base], "size int, q int, base long, start long"))
        salts = -(-max(waiting.values()) // PART_ROWS)
        rows = ranked(self.state.where(F.col("kind") == WAITING), ["size"], [F.asc("first")], salts).join(table, "size")
        rows = rows.withColumn("at", F.col("base") + F.col("rank")).withColumn("sequence", F.col("start") + F.floor(F.col("at") / F.col("q")))
        inside = Window.partitionBy("sequence").orderBy("at")
        end = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumn("offset", end - F.col("size")).withColumn("last", F.lead("at").over(inside).isNull()).withColumn("gap", self.capacity - end)
        none = F.lit(None).cast("int")
        placed = F.struct(F.lit(PLACED).alias("kind"), "size", "length", "first", "n", "sequence", F.col("offset").cast("int").alias("offset"))
        gap = F.struct(F.lit(GAP).alias("kind"), F.col("gap").cast("int").alias("size"), none.alias("length"), none.cast("long").alias("first"), none.alias("n"), "sequence", none.alias("offset"))
        both = rows.select(F.inline(F.when(F.col("last") & (F.col("gap") > 0), F.array(placed, gap)).otherwise(F.array(placed))))
        self.keep(both.unionByName(self.state.where(F.col("kind") == GAP)))

    def fill(self) -> None:
        """The short pieces: runs of them meet gaps, at half the length each time."""
        short = {length: n for length, n in self.counts.items() if length <= self.capacity // (LAST + 1)}
        if not short:
            return
        half = 1 << (self.capacity.bit_length() - 2)
        size = F.greatest(F.lit(1), F.floor(half / F.col("length"))).cast("int")
        runs = self.numbered.where(F.col("length") <= max(short)).groupBy("length", F.floor(F.col("rank") / size).alias("run"))
        self.add(runs.agg(F.min("rank").alias("first"), F.count(F.lit(1)).cast("int").alias("n")))
        limit, stuck = half, False
        while True:
            gaps, waiting = self.sizes()
            if not waiting:
                return
            lack = sum(s * n for s, n in waiting.items()) - (0 if stuck else sum(s * n for s, n in gaps.items()))
            if lack > 0:
                gaps[self.capacity] = gaps.get(self.capacity, 0) + self.open_empty(-(-lack // self.capacity))
            stuck = False
            if max(gaps) >= min(waiting):
                self.sweep(gaps, waiting)
                if max(gaps) < 2 * limit:
                    limit = max(1, limit // 2)
                    self.split(limit)
            elif limit > 1:  # no gap holds a run: shorter runs, as long as the widest gap
                limit = min(limit // 2, 1 << (max(gaps).bit_length() - 1))
                self.split(limit)
            else:  # no gap holds a piece
                limit, stuck = half, True
                self.join_runs(half)

    def open_empty(self, n: int) -> int:
        empty = [F.lit(None).cast(t).alias(c) for c, t in (("length", "int"), ("first", "long"), ("n", "int"))]
        new = self.spark.range(self.made, self.made + n)
        rows = new.select(F.lit(GAP).alias("kind"), F.lit(self.capacity).alias("size"), *empty, F.col("id").alias("sequence"), F.lit(None).cast("int").alias("offset"))
        self.state = self.state.unionByName(rows)
        self.made += n
        return n

    def join_runs(self, limit: int) -> None:
        """Waiting single pieces of one length and adjacent ranks become runs of at most ``limit`` tokens."""
        waits = self.state.where(F.col("kind") == WAITING).select("length", "first")
        most = waits.groupBy("length").count().agg(F.max("count")).first()[0]
        rows = ranked(waits, ["length"], [F.asc("first")], -(-most // PART_ROWS))
        part = F.floor(F.col("rank") / F.greatest(F.lit(1), F.floor(limit / F.col("length"))))
        runs = rows.groupBy("length", (F.col("first") - F.col("rank")).alias("island"), part.alias("part"))
        self.state = self.state.where(F.col("kind") == GAP)
        self.add(runs.agg(F.min("first").alias("first"), F.count(F.lit(1)).cast("int").alias("n")))

    def split(self, limit: int) -> None:
        """Waiting runs longer than ``limit`` tokens become runs that are not, or single pieces."""
        step = F.greatest(F.lit(1), F.floor(limit / F.col("length"))).cast("int")
        waits = self.state.where(F.col("kind") == WAITING).select("length", "first", "n", step.alias("step"))
        parts = waits.select("length", "first", "n", "step", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.col("step"))).alias("k"))
        self.state = self.state.where(F.col("kind") == GAP)
        self.add(parts.select("length", (F.col("first") + F.col("k")).alias("first"), F.least(F.col("step"), F.col("n") - F.col("k")).alias("n")))


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, scratch: Scratch | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece of the documents.

    A null or empty text is one piece that holds only the end id. Repeated rows are packed as often as they
    occur; rows without an id like others. No rows: an empty table. The pieces and each round are written once, so
    later rounds and the rows that meet them are the same even if an executor is lost between them.
    """
    scratch = scratch or Scratch(docs.sparkSession, "packing")
    all_pieces = scratch.table(pieces(docs, path, capacity), "pieces")
    counts = {r["length"]: r["count"] for r in all_pieces.groupBy("length").count().collect()}  # at most one row a length
    counts.pop(capacity, 0)  # a whole sequence each: numbered below 0, without a rank
    whole = all_pieces.where(F.col("length") == capacity)
    whole = whole.select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    salts = -(-max(counts.values(), default=1) // PART_ROWS)
    order = [F.asc(c) for c in ("doc_id", "piece", "start", "ids_crc32")]
    part = ranked(all_pieces.where(F.col("length") < capacity), ["length"], order, salts).withColumn("length", F.col("length").cast("int"))
    part = scratch.table(part, "numbered")
    placed = Rounds(part.select("length", "rank"), counts, capacity, scratch).run()
    met = part.join(placed, ["length", "rank"])
    return whole.union(met.select("doc_id", "piece", "start", F.col("length").cast("long"), "ids_crc32", F.col("sequence").alias("sequence_id"), F.col("offset").cast("long")))
