"""Spelling variants against all pairs on small vocabularies, and against SQL."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from kerbline.llm import queries, spelling as sp, sql

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute(vocabulary):
    near = {w: sorted((v for v in vocabulary if one_apart(w, v)), key=lambda v: (-vocabulary[v], v)) for w in vocabulary}
    form = {w: x[0] if x and vocabulary[x[0]] >= 10 * vocabulary[w] else None for w, x in near.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n, len(near[w]), vocabulary.get(form[w], 0)) for w, n in vocabulary.items())


def answer(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in df.collect())


def words_of(rows):
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def test_neighbours_are_all_words_within_one_edit():
    r = random.Random(1)
    for k, n in ((2, 1), (3, 4), (4, 7)):
        s = np.array([[r.randrange(k) for _ in range(n)] for _ in range(5)], np.uint8)
        got = [set() for _ in s]
        total = 0
        for h, rows in sp.neighbours(s, k):
            total += len(h)
            for x, i in zip(h.tolist(), rows.tolist()):
                got[i].add(x)
        for row, found in zip(s.tolist(), got):
            want = {(*row[:i], *row[i + 1 :]) for i in range(n)} | {(*row[:i], t, *row[i + 1 :]) for i in range(n) for t in range(k)}
            want |= {(*row[:i], t, *row[i:]) for i in range(n + 1) for t in range(k)}
            want.discard(tuple(row))
            assert found == {int(sp.hashes(np.array([w], np.uint8).reshape(1, -1), k)[0]) for w in want}
        assert total == sum(map(len, got))  # none twice
        parts = [x for i in range(0, n + 1, 2) for h, _ in sp.neighbours(s, k, i, i + 2) for x in h.tolist()]
        assert sorted(parts) == sorted(x for h, _ in sp.neighbours(s, k) for x in h.tolist())


@pytest.mark.parametrize("crowd,k", [(128, None), (3, 4), (0, 6)])
def test_against_all_pairs(spark, monkeypatch, crowd, k):
    """With ordinary cells, with most words in crowds, and with all of them in crowds."""
    monkeypatch.setattr(sp, "CROWD", crowd)
    r = random.Random(4)
    vocabulary = {}
    for _ in range(60):
        w = "".join(r.choice("abcdeé÷ÿ") for _ in range(r.randint(7, 10)))
        vocabulary[w] = r.choice([5, 60, 700, 9000])
        for _ in range(8):
            i = r.randrange(len(w) + 1)
            w = r.choice([w[:i] + r.choice("abzé") + w[i:], w[:i] + r.choice("abzé") + w[i + 1 :], w[:i] + w[i + 1 :] or w])
            vocabulary[w] = r.choice([2, 5, 50, 700])
    vocabulary |= {"a" * 3000: 2, "a" * 3001: 40, "a" * 2999 + "b": 2, "aaaaaaa": 3, "aaaaaaaa": 30}
    df = spark.createDataFrame(list(vocabulary.items()), "word string, n long").repartition(3)
    assert answer(sp.grouped(df, k=k)) == brute(vocabulary)


def test_texts(spark):
    """Null, empty and long texts, no id, repeated rows, letters beyond ASCII, clashing columns."""
    r = random.Random(8)
    base = ["Straßburg", "recieved", "received", "ÉCOLIERS", "écoliers", "éCOLIERS", "naïveté", "shorter", "a×b÷cdef", "tiny", "Ωmegawords", "separate", "seperate"]
    rows = [(i, " ".join(r.choice(base) for _ in range(40)) + ("-" if i % 2 else ".") + "received3received") for i in range(60)]
    rows += [(None, "received naïveté received"), (None, None), (90, ""), (91, "received " * 5000), (92, "x" * 50_000 + " " + "x" * 50_000), rows[3], rows[3]]
    df = spark.createDataFrame([(*x, "clash", 1) for x in rows], "doc_id long, text string, word string, n long").repartition(4)
    assert answer(sp.variants(df)) == brute(words_of(rows))


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert sp.variants(df).count() == 0


def test_alphabet_grows_with_the_vocabulary():
    sizes = [sp.symbols_for(10**i) for i in range(10)]
    assert sizes == sorted(sizes) and sizes[0] == 4 and sizes[9] >= 8


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted((w, f or "", r, n, c, m or 0) for w, f, r, n, c, m in con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({sql.spelling()})").fetchall())
    out = queries.op11_spelling_variants(spark, sf)
    assert out.columns == COLUMNS and [f.dataType.simpleString() for f in out.schema] == ["string"] * 3 + ["bigint"] * 3
    assert answer(out) == want and len(want) > 1000
