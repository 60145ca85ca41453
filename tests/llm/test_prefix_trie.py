"""The conversation trie against a plain trie in Python, and against SQL."""

import hashlib
import random
import zlib

import duckdb
import pytest

from kerbline.llm import prefix_trie as pt, queries, sql
from kerbline.scratch import Scratch

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, place long, depth string"


def rows():
    """Repeated and null turn numbers, null roles and texts, a hot conversation, a long one, absent donors, no id."""
    r = random.Random(7)
    shared = [(t, "user" if t % 2 == 0 else "assistant", f"té {t}") for t in range(6)]
    out = []
    for c in range(0, 150):
        if c % 35 == 0:
            continue  # donors that are absent
        k = r.randint(1, 6)
        turns = shared[:k] if r.random() < 0.6 else [(t, r.choice(["user", None]), r.choice(["a", "b", None, ""])) for t in range(k)]
        out += [(c, *t) for t in turns]
    out += [(c, *t) for c in range(1000, 2300) for t in shared[:3]]
    out += [(7777, t, "user", f"long {t % 3}") for t in range(60)] + [(7778, t, "user", f"long {t % 3}") for t in range(50)]
    out += [(9000, None, "user", "first"), (9000, 3, "user", "x"), (9000, 3, "user", "x"), (None, 0, "user", "nobody"), (None, 1, None, None)]
    return out


def brute(data):
    by = {}
    for c, t, role, text in data:
        if c is not None:
            by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    by = {c: [x[2:] for x in sorted(v)] for c, v in by.items()}
    seqs = {}
    for c in by:
        h = zlib.crc32(str(c).encode()) % 9
        seqs[c] = tuple(by.get(c - c % 5, [])[:h] + by[c][h:])
    members = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    children, saved, leaves = {}, dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
            leaves[p[:d]] += p not in children
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves[p], saved[p],
         hashlib.sha256(",".join(str(c) for c in sorted(m) if len(seqs[c]) == len(p)).encode()).hexdigest())
        for p, m in members.items()
    )


def answer(df):
    return sorted(tuple(x) for x in df.select(*COLUMNS).collect())


@pytest.mark.parametrize("chunk", [pt.CHUNK, 4])
def test_against_a_plain_trie(spark, monkeypatch, chunk):
    """Also with chunks of four turns, so that scans are carried from chunk to chunk."""
    monkeypatch.setattr(pt, "CHUNK", chunk)
    monkeypatch.setattr(pt, "PIECE", 100)
    data = rows()
    df = spark.createDataFrame([(*x, 5, "clash") for x in data], SCHEMA).repartition(5)
    s = Scratch(spark, "t")
    assert answer(pt.trie(*pt.rebuilt(df, s), s)) == brute(data)


def test_no_rows(spark):
    s = Scratch(spark, "t")
    assert answer(pt.trie(*pt.rebuilt(spark.createDataFrame([], SCHEMA), s), s)) == []


def test_only_turnless_conversations(spark):
    """A conversation shorter than what it gives up, whose donor is absent, ends at the root."""
    c = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    s = Scratch(spark, "t")
    out = answer(pt.trie(*pt.rebuilt(spark.createDataFrame([(c, 0, "user", "x", None, None)], SCHEMA), s), s))
    assert out == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = sorted(con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({sql.prefix_trie()})").fetchall())
    out = queries.op12_prefix_trie(spark, sf)
    assert out.columns == COLUMNS and {f.dataType.simpleString() for f in out.schema} == {"bigint", "string"}
    assert answer(out) == want and len(want) > 100
