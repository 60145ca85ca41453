"""Spelling variants: words one edit apart, found by one-edit neighbourhoods in a reduced alphabet.

Letters are hashed to a few symbols. Words one edit apart reduce to equal words or to words one edit apart, so every
distinct reduced word gets its full neighbourhood of one insertion, deletion or replacement over the few symbols, as
64-bit hashes, and meets the reduced vocabulary in a join. The words behind each pair of reduced words are then
compared as they are; a hash can only add candidates, never lose one. The relation is symmetric, so of a pair of
reduced words only the one with the larger hash looks for the other.

The alphabet grows with the vocabulary, so that a reduced word stands for few words. Where it still stands for more
than ``CROWD`` words (or ``CROWD_CHARS`` characters), those words use the same method with every letter its own symbol:
their candidates are their links, and nothing is compared within the crowd.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.llm.common import lower_ascii
from kerbline.scratch import Scratch

#: Letters of a run, after lower-casing A-Z; "÷" and "×" lie within the range and count as letters.
LETTERS = "".join(map(chr, [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]))
RUN = "[A-Za-zÀ-ÿ]"
MIN_LENGTH, MIN_COUNT, TIMES = 7, 2, 10
CROWD, CROWD_CHARS = 128, 1 << 14
#: Rows that a task hands on at once.
BATCH = 1 << 18
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


# --- hashes of words and of their neighbours --------------------------------------------------


def _mixed(x: np.ndarray, length: int) -> np.ndarray:
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9) + _U(length)
    x = (x ^ (x >> _U(32))) * _U(0x94D049BB133111EB)
    return (x ^ (x >> _U(30))).view(np.int64)


def _symbol_values(k: int) -> np.ndarray:
    return (np.arange(1, k + 1, dtype=np.uint64) * _U(0xD6E8FEB86659FD93)) ^ _U(0xA0761D6478BD642F)


def _powers(n: int) -> np.ndarray:
    p = np.full(n, _BASE, _U)
    p[:1] = 1
    return np.multiply.accumulate(p)


def hashes(symbols: np.ndarray, k: int) -> np.ndarray:
    """Hash of each word, a row of symbols below ``k``."""
    n = symbols.shape[1]
    return _mixed((_symbol_values(k)[symbols] * _powers(n)).sum(axis=1, dtype=_U), n)


def neighbours(symbols: np.ndarray, k: int, start: int = 0, end: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the words within one edit of each row's word, itself left out, with the numbers of the rows.

    Every distinct neighbour once: of equal symbols in a row the first is deleted, and nothing is inserted before its
    like. ``start, end``: the places to edit, so that a very long word can be taken in parts.
    """
    m, n = symbols.shape
    v, pw = _symbol_values(k), _powers(n + 1)
    terms = v[symbols] * pw[:n]
    before = np.zeros((m, n + 1), _U)
    np.cumsum(terms, axis=1, out=before[:, 1:])
    whole = before[:, n]
    row = np.arange(m)
    for i in range(start, (n + 1) if end is None else min(end, n + 1)):
        after, added = whole - before[:, i], v * pw[i]
        longer = before[:, i] + after * _U(_BASE)
        if i < n:
            here, rest = symbols[:, i], whole - before[:, i + 1]
            fresh = row if i == 0 else np.flatnonzero(here != symbols[:, i - 1])
            yield _mixed((before[:, i] + rest * _U(_INVERSE))[fresh], n - 1), fresh
            base = before[:, i] + rest
        for t in range(k):
            if i < n:
                other = np.flatnonzero(here != t)
                yield _mixed((base + added[t])[other], n), other
                yield _mixed((longer + added[t])[other], n + 1), other
            else:
                yield _mixed(longer + added[t], n + 1), row


def _by_length(words: list[str], alphabet: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of one length as rows of symbols, with their numbers."""
    code = np.zeros(256, np.uint8)
    code[[ord(c) for c in alphabet]] = np.arange(len(alphabet))
    length = np.array([len(w) for w in words])
    for n in np.unique(length):
        of = np.flatnonzero(length == n)
        raw = np.frombuffer("".join(words[i] for i in of).encode("latin-1"), np.uint8).reshape(len(of), int(n))
        yield code[raw], of


def _hash_column(df: DataFrame, column: str, alphabet: str, out: str) -> DataFrame:
    """Adds the hash of a word column over ``alphabet``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            h = np.zeros(len(f), np.int64)
            for symbols, of in _by_length(f[column].tolist(), alphabet):
                h[of] = hashes(symbols, len(alphabet))
            yield f.assign(**{out: h})

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in df.schema), f"{out} long"])
    return df.mapInPandas(run, schema)


def _neighbour_table(df: DataFrame, column: str, key: str, alphabet: str, half: bool) -> DataFrame:
    """``key, near``: each word's hash with that of each word within one edit, itself included.

    ``half``: only those that are not above the word's own.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            held, size = [], 0
            for symbols, of in _by_length(f[column].tolist(), alphabet):
                keys = f[key].to_numpy(np.int64)[of]
                held.append((keys, keys))
                size += len(keys)
                step = max(1, BATCH // symbols.shape[1])  # rows at once, and places at once of longer words
                for a in range(0, len(of), step):
                    own = keys[a : a + step]
                    for i in range(0, symbols.shape[1] + 1, BATCH):
                        for near, rows in neighbours(symbols[a : a + step], len(alphabet), i, i + BATCH):
                            mine = own[rows]
                            if half:
                                keep = near < mine
                                near, mine = near[keep], mine[keep]
                            held.append((mine, near))
                            size += len(near)
                            if size >= BATCH:
                                yield _frame(held, key)
                                held, size = [], 0
            if held:
                yield _frame(held, key)

    return df.select(column, key).mapInPandas(run, f"{key} long, near long")


def _frame(held: list[tuple[np.ndarray, np.ndarray]], key: str) -> pd.DataFrame:
    return pd.DataFrame({key: np.concatenate([a for a, _ in held]), "near": np.concatenate([b for _, b in held])})


# --- the vocabulary ---------------------------------------------------------------------------


def occurrences(docs: DataFrame, min_length: int = MIN_LENGTH, drop_every: int = 31) -> DataFrame:
    """``word, n``: the words of ``min_length`` letters or more in whole texts, after the seeded deletions.

    Of a run whose CRC-32 of ``<doc_id>:<run>`` is a multiple of ``drop_every`` the letter at CRC modulo its length is
    left out. A null text has no words; a null id counts as an empty one. Shorter runs can yield no word.
    """
    runs = F.regexp_extract_all("text", F.lit(f"{RUN}{{{min_length},}}"), F.lit(0))
    r = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(runs).alias("run"))
    r = r.select("d", lower_ascii(F.col("run")).alias("run"))
    h = F.crc32(F.concat("d", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = r.select(F.when(h % drop_every == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= min_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def symbols_for(n_words: int) -> int:
    """Symbols so that reduced words of eight letters outnumber a sixteenth of the vocabulary; four at least."""
    return next(k for k in (4, 6, 8, 12, 16, 24) if k == 24 or k**8 * 16 >= n_words)


def reduced(word: Column, k: int) -> Column:
    """Letters hashed to ``k`` symbols, which are the first ``k`` letters."""
    return F.translate(word, LETTERS, "".join(LETTERS[ord(c) % k] for c in LETTERS))


# --- links ------------------------------------------------------------------------------------


def links(vocabulary: DataFrame, scratch: Scratch, k: int | None = None) -> DataFrame:
    """``a, a_n, b, b_n``: each pair of words (word, n) one edit apart, once.

    Words are distinct and consist of ``LETTERS``.
    """
    k = k or symbols_for(vocabulary.count())
    few = LETTERS[:k]
    words = _hash_column(vocabulary.withColumn("reduced", reduced(F.col("word"), k)), "reduced", few, "cell")
    words = scratch.table(words, "words")
    size = words.groupBy("cell").agg(F.count(F.lit(1)).alias("size"), F.sum(F.length("word")).alias("chars"))
    crowded = (F.col("size") > CROWD) | ((F.col("size") > 1) & (F.col("chars") > CROWD_CHARS))
    words = scratch.table(words.join(size, "cell").select("word", "n", "cell", "reduced", crowded.alias("crowded")), "words")
    loose = words.where(~F.col("crowded"))
    cells = loose.groupBy("cell", "reduced").agg(F.count(F.lit(1)).alias("n"))  # two reduced words may share a hash
    pairs = _neighbour_table(cells, "reduced", "cell", few, half=True)
    pairs = pairs.join(loose.select(F.col("cell").alias("near")).distinct(), "near").distinct()
    a, b = (loose.select(F.col("word").alias(x), F.col("n").alias(f"{x}_n"), F.col("cell").alias(c)) for x, c in (("a", "cell"), ("b", "near")))
    met = pairs.join(a, "cell").join(b, "near")
    one_edit = F.levenshtein("a", "b", 1) == 1
    found = met.where(one_edit & ((F.col("cell") != F.col("near")) | (F.col("a") < F.col("b")))).select("a", "a_n", "b", "b_n")
    return found.union(_crowded_links(words))


def _crowded_links(words: DataFrame) -> DataFrame:
    """Links of words in crowds: with every letter a symbol a neighbour's hash names the word itself."""
    exact = _hash_column(words.select("word", "n", "crowded"), "word", LETTERS, "key")
    tight = exact.where("crowded")
    near = _neighbour_table(tight, "word", "key", LETTERS, half=False)
    a = tight.select(F.col("word").alias("a"), F.col("n").alias("a_n"), "key")
    b = exact.select(F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("key").alias("near"), F.col("crowded").alias("both"))
    met = near.distinct().join(b, "near").join(a, "key")
    return met.where((F.levenshtein("a", "b", 1) == 1) & (~F.col("both") | (F.col("a") < F.col("b")))).select("a", "a_n", "b", "b_n")


def grouped(vocabulary: DataFrame, scratch: Scratch | None = None, k: int | None = None, times: int = TIMES) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each word of ``vocabulary`` (word, n).

    ``form``: the near word of largest n, ties to the smallest by code point, if that n is ``times`` the word's or more.
    ``root``: where following forms ends, the word itself if it has none. No words: an empty table.
    """
    scratch = scratch or Scratch(vocabulary.sparkSession, "spelling")
    vocabulary = scratch.table(vocabulary, "vocabulary")
    pair = lambda w, x: F.struct(F.col(w).alias("word"), F.col(x).alias("near"), F.col(f"{x}_n").alias("near_n"))
    both = links(vocabulary, scratch, k).select(F.inline(F.array(pair("a", "b"), pair("b", "a"))))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    judged = vocabulary.join(best, "word", "left").withColumn("ok", -F.col("best.less") >= F.col("n") * times)
    judged = scratch.table(judged.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("ok"), F.col("best.near")).alias("form"),
        F.when(F.col("ok"), -F.col("best.less")).alias("form_n"),
    ), "judged")
    roots = _roots(judged, scratch)
    out = judged.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(judged: DataFrame, scratch: Scratch) -> DataFrame:
    """``word, root`` of the words with a form. Counts grow along a chain, so it ends, and each round doubles the step."""
    steps = scratch.table(judged.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = scratch.table(steps.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        done = longer.where("moved").isEmpty()
        scratch.drop(steps)
        steps = longer.select("word", "root")
        steps._scratch_path = longer._scratch_path
        if done:
            return steps


def variants(docs: DataFrame, scratch: Scratch | None = None, min_count: int = MIN_COUNT) -> DataFrame:
    """Spelling groups of the words of ``docs`` (doc_id, text) that occur ``min_count`` times or more."""
    return grouped(occurrences(docs).where(F.col("n") >= min_count), scratch)
