"""Chat formatting with typed content parts.

A message is an array of parts. A visitor flattens them in order: text is escaped, while images, audio clips and
documents leave a placeholder, and their references and the tokens they expand to are recorded beside it. Turns
are marked by control strings, which texts cannot contain once escaped, so a formatted conversation can be read
back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Tokens that an attachment expands to: an image by its patches, audio by its seconds, a document by its pages.
PATCH, PER_SECOND, PER_PAGE = 28, 25, 600
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escaped(text: Column) -> Column:
    """Reversible: backslashes are doubled, then one goes inside each control string's beginning, be it this
    template's or a common other's (``<|``, ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``)."""
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, r"<(?=[|]|/?s>)|\[(?=/?INST\])", "$0\\\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_part(text: Column) -> Column:
    """The array of parts of a plain text message."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]).cast(PART))


def _visit(part: Column) -> Column:
    """One part: its text or its placeholder, its reference and its expanded tokens (none for text)."""
    kind = part["type"]
    up = lambda x, by: F.ceil(F.coalesce(x, F.lit(0)) / F.lit(by)).cast("long")
    tokens = F.when(kind == "image", up(part["width"], PATCH) * up(part["height"], PATCH)).when(kind == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * F.lit(PER_SECOND)).cast("long")).when(kind == "document", F.coalesce(part["pages"], F.lit(0)).cast("long") * PER_PAGE)
    mark = F.lit(None).cast("string")
    for name, shown in PLACEHOLDERS.items():
        mark = F.when(kind == name, F.lit(shown)).otherwise(mark)
    return F.struct(mark.alias("mark"), F.coalesce(part["text"], F.lit("")).alias("text"), kind.alias("type"), part["ref"].alias("ref"), tokens.alias("tokens"))


def _body(visited: Column) -> Column:
    """The flattened parts. Texts that follow each other are escaped as one, so that no control string can be put
    together from several parts; a placeholder ends such a run."""
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("run"))
    placed = lambda acc, v: F.struct(F.concat(acc["done"], escaped(acc["run"]), v["mark"]).alias("done"), F.lit("").alias("run"))
    longer = lambda acc, v: F.struct(acc["done"].alias("done"), F.concat(acc["run"], v["text"]).alias("run"))
    step = lambda acc, v: F.when(v["mark"].isNotNull(), placed(acc, v)).otherwise(longer(acc, v))
    return F.aggregate(visited, start, step, lambda acc: F.concat(acc["done"], escaped(acc["run"])))


def formatted(messages: DataFrame) -> DataFrame:
    """One row per conversation from ``conv_id, turn, role, parts``: ``conv_id, formatted, loss`` (start and
    length in code points of each assistant body), ``attachments`` (turn, type, ref, tokens, in order) and
    ``expanded_tokens``.

    Turns are ordered by turn, then role and content, nulls first; a null role or text is empty, null parts are
    none, unknown types count as text. Repeated rows are repeated turns. Rows with a null ``conv_id`` form one
    conversation. Other columns are not read. A conversation has to fit in one row, as it does in the output.
    """
    turn = messages.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("parts", F.array().cast(f"array<{PART}>")).alias("parts")).alias("m"))
    c = turn.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("m"))
    c = c.select("conv_id", F.transform("m", lambda m: F.struct(m["turn"].alias("turn"), m["role"].alias("role"), F.transform(m["parts"], _visit).alias("v"))).alias("m"))
    c = c.select("conv_id", F.transform("m", lambda m: F.struct(m["turn"].alias("turn"), m["role"].alias("role"), m["v"].alias("v"), F.concat(F.lit(TURN), escaped(m["role"]), F.lit(BODY)).alias("head"), _body(m["v"]).alias("body"))).alias("m"))
    whole = F.array_join(F.transform("m", lambda m: F.concat(m["head"], m["body"], F.lit(END))), "")
    step = lambda acc, m: F.struct((acc["at"] + F.length(m["head"]) + F.length(m["body"]) + len(END)).alias("at"), F.when(m["role"] == "assistant", F.concat(acc["loss"], F.array(F.struct((acc["at"] + F.length(m["head"])).alias("start"), F.length(m["body"]).cast("long").alias("length"))))).otherwise(acc["loss"]).alias("loss"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("loss"))
    parts = F.flatten(F.transform("m", lambda m: F.transform(F.filter(m["v"], lambda v: v["tokens"].isNotNull()), lambda v: F.struct(m["turn"].alias("turn"), v["type"].alias("type"), v["ref"].alias("ref"), v["tokens"].alias("tokens")))))
    c = c.select("conv_id", whole.alias("formatted"), F.aggregate("m", start, step, lambda acc: acc["loss"]).alias("loss"), parts.alias("attachments"))
    return c.withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda acc, a: acc + a["tokens"]))


def turns_of(formatted_text: Column) -> Column:
    """Roles and texts as they were, read back from a formatted conversation alone."""
    marked = F.filter(F.split(formatted_text, "<[|]turn[|]>"), lambda x: x != "")
    halves = F.transform(marked, lambda x: F.split(F.substring(x, F.lit(1), F.length(x) - len(END)), "<[|]body[|]>", 2))
    return F.transform(halves, lambda h: F.struct(unescaped(h[0]).alias("role"), unescaped(h[1]).alias("text")))


def loss_of(formatted_text: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    spans = F.transform(loss, lambda s: F.substring(formatted_text, (s["start"] + 1).cast("int"), s["length"].cast("int")))
    return F.array_join(F.transform(spans, unescaped), "")
