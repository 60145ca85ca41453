"""Quality rules by cross-document line frequency.

Lines are normalised and hashed; a line found in more documents of its host than a limit is boilerplate.
A document of which boilerplate makes up most words is depleted and rejected, as is one that fails the base
rules. Exact copies of a text count as one document: copies are the concern of deduplication, and counting
them would reject a copied clean text altogether.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.llm.common import GAP, SPACE, let, n_words, words
from kerbline.scratch import Scratch

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line is boilerplate above so many documents of its host, however large the host is.
LINE_DOCS = 20
#: A document is depleted when less than this share of its words is left.
LEAST_LEFT = 0.5
SYMBOLS = "#*$%&|<>"


def _has_word(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE)) != ""


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def repeat_words(text: Column) -> Column:
    """Words that lie in a three-word window which the text holds more than once.

    Window hashes are sorted with their positions, so a long text costs n log n within its row and no shuffle;
    the sort is skipped where all hashes differ.
    """

    def hashes(w: Column) -> Column:
        windows = F.sequence(F.lit(0), F.size(w) - 3)
        return F.when(F.size(w) < 3, F.array().cast("array<bigint>")).otherwise(F.transform(windows, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))

    def covered(s: Column) -> Column:
        alike = lambda k, j: F.coalesce(F.get(s, k)["h"] == F.get(s, j)["h"], F.lit(False))
        twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: alike(k, k - 1) | alike(k, k + 1))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda k: F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda d: F.get(s, k)["i"] + d)))))

    def count(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(placed, covered)).otherwise(0)

    return let(words(text), lambda w: let(hashes(w), count)).cast("long")


def measures(docs: DataFrame) -> DataFrame:
    """``row`` (all columns given), ``host``, ``digest``, and the base measures and verdict."""
    text = F.coalesce(F.col("row.text"), F.lit(""))
    lines = lambda count: let(F.filter(F.split(text, "\n"), _has_word), count).cast("long")
    d = docs.select(F.struct("*").alias("row")).select(
        "row",
        F.col("row.source").alias("host"),
        _digest(text).alias("digest"),
        n_words(text).alias("n_words"),
        F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines(lambda x: F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"),
        repeat_words(text).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return d.withColumn("base_failed", failed)


def _normal(line: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(line, GAP, " ")))


def _marked(docs: DataFrame, scratch: Scratch, line_docs: int) -> DataFrame:
    """``host, digest, line, w, gone``: the words of each text's lines, by the line's hash, and whether it is frequent.

    Copies of one text within a host are merged before any line is counted (their word sums scale alike,
    so shares stay right), and the counts combine before their shuffle: a line that every document has
    costs one row per task.
    """
    norm = _normal(F.col("line"))
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = docs.select(F.col("source").alias("host"), _digest(text).alias("digest"), F.explode(F.filter(F.split(text, "\n"), _has_word)).alias("line"))
    lines = lines.select("host", "digest", F.xxhash64(norm).alias("line"), F.size(F.split(norm, " ")).cast("long").alias("w"))
    lines = scratch.table(lines.groupBy("host", "digest", "line").agg(F.sum("w").alias("w")), "lines")
    often = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > line_docs).select("host", "line", F.lit(True).alias("gone"))
    a, b = lines.alias("a"), often.alias("b")
    return a.join(b, F.col("a.host").eqNullSafe(F.col("b.host")) & (F.col("a.line") == F.col("b.line")), "left").select("a.host", "a.digest", "a.line", "a.w", "b.gone")


def depleted(docs: DataFrame, scratch: Scratch, line_docs: int = LINE_DOCS, least_left: float = LEAST_LEFT) -> DataFrame:
    """``host, digest`` of the texts that lose too many words with their host's frequent lines."""
    marked = _marked(docs, scratch, line_docs)
    left = F.sum(F.when(F.col("gone"), 0).otherwise(F.col("w")))
    return marked.groupBy("host", "digest").agg(left.alias("left"), F.sum("w").alias("total")).where(F.col("left") < F.col("total") * least_left).select("host", "digest")


def judged(docs: DataFrame, scratch: Scratch | None = None, **limits: float) -> DataFrame:
    """``row``, the measures, ``base_failed`` and ``kept``, for documents with ``text`` and ``source``.

    A null text counts as empty, has no words and fails; a null source is a host of its own. Rows that
    repeat get the same verdict. Other columns are only carried along, in ``row``.
    """
    bad = depleted(docs, scratch or Scratch(docs.sparkSession, "lines"), **limits).withColumn("bad", F.lit(True)).alias("bad")
    m = measures(docs).alias("m")
    joined = m.join(bad, F.col("m.host").eqNullSafe(F.col("bad.host")) & (F.col("m.digest") == F.col("bad.digest")), "left")
    return joined.select("m.*", (~F.col("base_failed") & F.col("bad.bad").isNull()).alias("kept")).drop("host", "digest")


def kept_rows(docs: DataFrame, scratch: Scratch | None = None, **limits: float) -> DataFrame:
    """The documents that pass, unchanged."""
    return judged(docs, scratch, **limits).where("kept").select("row.*")


def cleaned(docs: DataFrame, scratch: Scratch | None = None, line_docs: int = LINE_DOCS, least_left: float = LEAST_LEFT) -> DataFrame:
    """The documents that pass, without the lines that are frequent at their host; other columns unchanged.

    Whether a document passes is judged on its whole text, as in ``judged``. Only the hashes of a text's frequent lines
    travel; they are taken out where the text is. A text without such lines stays as it is, to the byte.
    """
    scratch = scratch or Scratch(docs.sparkSession, "cleaned")
    gone = _marked(docs, scratch, line_docs).where("gone").groupBy("host", "digest").agg(F.collect_set("line").alias("lines")).alias("g")
    kept = kept_rows(docs, scratch, line_docs=line_docs, least_left=least_left).select(F.struct("*").alias("row")).alias("k")
    text = F.coalesce(F.col("k.row.text"), F.lit(""))
    met = kept.join(gone, F.col("k.row.source").eqNullSafe(F.col("g.host")) & (_digest(text) == F.col("g.digest")), "left")
    rest = F.filter(F.split("row.text", "\n"), lambda x: ~_has_word(x) | ~F.array_contains("lines", F.xxhash64(_normal(x))))
    out = met.select("row", "lines")
    return out.select(*[F.when(F.col("lines").isNull(), F.col("row.text")).otherwise(F.array_join(rest, "\n")).alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
