"""Homomorphic multiset fingerprints of documents.

A paragraph hashes to a wide vector; a document's fingerprint is the sum of its paragraphs' vectors, lane by
lane modulo a power of two. Sums do not depend on order, a paragraph is inserted by adding its vector and
deleted by subtracting it, and two documents are equal as multisets of paragraphs when all lanes agree.

The vector has two kinds of lanes. ``WIDE`` 64-bit lanes come from a cryptographic hash of the paragraph's
bytes and carry equality. ``SKETCH`` 32-bit lanes are a signed count sketch of the paragraph's word shingles:
inner products of such lanes estimate how many shingles two documents share, which gives a likeness.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm.common import literal_table, partitions
from kerbline.llm.text_hash import batches, shingle_hashes

WIDE, SKETCH, SHINGLE = 16, 256, 3


def vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Wide lanes (n x WIDE, modulo 2**64) and sketch lanes (n x SKETCH, modulo 2**32) of whole texts."""
    wide = np.zeros((len(texts), WIDE), np.uint64)
    sketch = np.zeros((len(texts), SKETCH), np.int64)
    for a, b in batches(texts):
        parts = [t.encode("utf-8", "surrogatepass").split(b"\n") for t in texts[a:b]]
        owner = np.repeat(np.arange(a, b), [len(p) for p in parts])
        parts = [x for p in parts for x in p]
        digests = np.frombuffer(b"".join(hashlib.shake_128(x).digest(8 * WIDE) for x in parts), "<u8").reshape(-1, WIDE)
        np.add.at(wide, owner, digests)
        h, of = shingle_hashes(parts, SHINGLE, lower=False)
        cell = owner[of] * SKETCH + (h & np.uint64(SKETCH - 1)).astype(np.int64)
        sign = ((h >> np.uint64(40)) & np.uint64(1)).astype(np.int64) * 2 - 1
        sketch[a:b] += np.bincount(cell - a * SKETCH, sign, (b - a) * SKETCH).astype(np.int64).reshape(-1, SKETCH)
    return wide, sketch.astype(np.uint32)


def encoded(wide: np.ndarray, sketch: np.ndarray) -> list[str]:
    return [base64.b64encode(w.astype("<u8").tobytes() + s.astype("<u4").tobytes()).decode() for w, s in zip(wide, sketch, strict=True)]


def decoded(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = base64.b64decode(fingerprint)
    return np.frombuffer(raw, "<u8", WIDE), np.frombuffer(raw, "<u4", SKETCH, 8 * WIDE)


def combined(a: str, b: str, sign: int = 1) -> str:
    """The fingerprint of ``a`` with ``b``'s paragraphs inserted, or deleted for ``sign=-1``."""
    (wa, sa), (wb, sb) = decoded(a), decoded(b)
    wide, sketch = (wa + wb, sa + sb) if sign > 0 else (wa - wb, sa - sb)
    return encoded(wide[None], sketch[None])[0]


def likeness(wide_a: np.ndarray, a: np.ndarray, wide_b: np.ndarray, b: np.ndarray) -> np.ndarray:
    """From 0 to 1, row by row: shared shingles over the mean of both counts, as the sketches estimate it;
    exactly 1 where all lanes agree."""
    x, y = a.astype(np.int32).astype(np.float64), b.astype(np.int32).astype(np.float64)
    size = (x * x).sum(1) + (y * y).sum(1)
    out = np.clip(2 * (x * y).sum(1) / np.where(size > 0, size, 1), 0, 1)
    return np.where((wide_a == wide_b).all(1) & (a == b).all(1), 1.0, out)


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text, mine`` dealt to tasks by ranges of descending ids, each sorted, each followed by rows
    (``mine`` false) with the first document of the next range. One shuffle of the texts.

    Ranges are cut at quantiles of the ids; only their bounds and first ids reach the driver.
    """
    n = partitions(docs)
    d = docs.select(F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("at"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cuts = sorted(set(d.agg(F.percentile_approx("at", [k / n for k in range(1, n)] or [0.5], F.lit(10_000))).first()[0] or []))
    # range k holds the ids above k cuts; the highest comes first
    where = F.lit(0) if not cuts else F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("at")))
    d = d.withColumn("range", where)
    first = {r["range"]: r["at"] for r in d.groupBy("range").agg(F.max("at").alias("at")).collect()}
    order = sorted(first, reverse=True)
    follow = [(first[b], a) for a, b in zip(order, order[1:] + order[:1], strict=True)]
    heads = literal_table(docs.sparkSession, follow, "at long, to int")
    halo = d.join(heads, "at").select("doc_id", "text", F.col("to").alias("range"), F.lit(False).alias("mine"))
    both = d.select("doc_id", "text", "range", F.lit(True).alias("mine")).union(halo)
    dealt = both.repartitionById(len(cuts) + 1, F.col("range"))
    return dealt.sortWithinPartitions("range", F.col("mine").desc(), F.col("doc_id").desc_nulls_last(), F.xxhash64("text")).select("doc_id", "text", "mine")


def edited(text: str, following: str) -> str:
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _rows(ids: list, texts: list[str]) -> pd.DataFrame:
    """One row for each text but the last, which only serves as a next one."""
    changed = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
    (wide, sketch), (wide_e, sketch_e) = vectors(texts), vectors(changed)
    n = len(changed)
    return pd.DataFrame({
        "doc_id": pd.array(ids[:n], "Int64"), "n_chars": [len(t) for t in texts[:n]],
        "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
        "fingerprint": encoded(wide[:n], sketch[:n]), "edited_fingerprint": encoded(wide_e, sketch_e),
        "near_edited": likeness(wide[:n], sketch[:n], wide_e, sketch_e), "near_next": likeness(wide[:n], sketch[:n], wide[1:], sketch[1:]),
    })


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    ids, texts, held, closed = [], [], 0, False
    for f in frames:
        for i, t, mine in zip(f["doc_id"], f["text"], f["mine"], strict=True):
            if closed:
                continue
            ids.append(None if pd.isna(i) else int(i))
            texts.append(t)
            held += len(t)
            closed = not mine
            if (held > 1 << 21 or closed) and len(texts) > 1:
                yield _rows(ids, texts)
                ids, texts, held = ids[-1:], texts[-1:], len(t)


def compared(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, its edited text's, and its likeness to that and to the next document's.

    The next document is the one before in order of ids; rows without an id come last, rows that share an id
    follow each other in order of their texts' hashes. A null text is an empty one: all lanes of an empty
    paragraph, likeness 1 to another empty text. A single document is its own next. No rows: an empty table.
    """
    return with_next(docs).mapInPandas(_compare, SCHEMA)
