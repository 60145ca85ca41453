"""Token files against the plain library call, document by document, and reading by range."""

import io
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kerbline.llm import queries, token_files as tf
from kerbline.scratch import Scratch

ODD = [
    None, "", " ", "\n", "one", "don't  can'T \t x's", "a<|endoftext|>b <|startoftext|> c", "é ́ \n̈a", "ΣΑΣ Σ", "日本語 12 3a!?...",
    "\x1c \x1f a\x0bb\x0cc\x85d e", "İı I ＦＵＬＬ", "nospace" * 300, "naïve café " * 40_000,
]


@pytest.fixture(scope="module")
def model():
    return queries.word_model()


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, start string, file string").repartition(3)


def expected(model, rows):
    """All rows in order of id (null first), ties in any order that agrees with what was read."""
    t = Tokenizer.from_str(model)
    return [(i, [*t.encode(x or "", add_special_tokens=False).ids, 1]) for i, x in rows]


def test_every_document_and_its_place(spark, model):
    r = random.Random(3)
    big = 2**60
    rows = [(big - i if i % 2 else i, x) for i, x in enumerate(ODD)] + [(100 + i, " ".join(r.choice(["alpha", "Beta", "gam-ma", "δέλτα"]) for _ in range(r.randint(1, 60)))) for i in range(200)]
    rows += [(None, "no id"), (None, "no id"), rows[20]]
    files = tf.write(table(spark, [(*x, "clash", None) for x in rows]), model, Scratch(spark, "t"), block=1000)
    got = [tuple(x) for x in files.documents().orderBy("start").collect()]
    want = expected(model, rows)
    assert sorted((repr(g[0]), g[2], g[3]) for g in got) == sorted((repr(i), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want)
    assert [g[0] is not None for g in got] == sorted(g[0] is not None for g in got)
    assert (ids := [g[0] for g in got if g[0] is not None]) == sorted(ids)
    assert [g[1] for g in got] == np.cumsum([0] + [g[2] for g in got])[:-1].tolist()
    # any range, decoded from its own blocks
    whole = files.ids(0, got[-1][1] + got[-1][2])
    assert len(whole) == got[-1][1] + got[-1][2]
    for g in got[::17]:
        assert zlib.crc32(files.ids(g[1], g[2]).tobytes()) == g[3]
    assert (files.ids(990, 25) == whole[990:1015]).all()


def test_planes_round_trip_and_cut_files_are_refused():
    a = np.random.default_rng(1).integers(0, 2**32, 2503, dtype=np.uint64).astype("<u4")
    for unit in ("byte", "bit"):
        out = io.BytesIO()
        w = tf.Writer(out, unit, block=500)
        for part in (a[:7], a[7:1999], a[1999:]):
            w.add(part)
        w.end(5, 2503)
        w.close()
        r = tf.Reader(io.BytesIO(out.getvalue()), len(out.getvalue()))
        assert (r.ids(0, 2503) == a).all() and (r.ids(499, 2) == a[499:501]).all() and len(r.index["blocks"]) == 6
        assert list(r.checksums()) == [(5, 0, 2503, zlib.crc32(a.tobytes()))]
        with pytest.raises(ValueError):
            tf.Reader(io.BytesIO(out.getvalue()[:-3]), len(out.getvalue()) - 3)


def test_zero_planes_take_no_room():
    out = io.BytesIO()
    w = tf.Writer(out)
    w.add(np.arange(200, dtype="<u4"))
    w.close()
    assert [n > 0 for n in tf.Reader(io.BytesIO(out.getvalue()), len(out.getvalue())).index["blocks"][0][1]] == [True, False, False, False]


def test_forgetting_words_changes_nothing(model, monkeypatch):
    monkeypatch.setattr(tf, "REMEMBERED", 50)
    texts = [f"word{i} again word{i % 7}" for i in range(300)]
    e, t = tf.Encoder(model), Tokenizer.from_str(model)
    flat = [e([x])[0].tolist() for x in texts]
    assert flat == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_words_of_letters_take_the_short_way(model):
    r = random.Random(6)
    marks = ".,;:!?()[]{}*+=/#%&$@_-"
    words = ["".join(r.choice("abcDEFghIÉéß'x1") for _ in range(r.randint(1, 9))) + "".join(r.choice(marks) for _ in range(r.randint(0, 3))) for _ in range(4000)]
    words += [a + b for a in ("It", "re", "LL") for b in marks]
    e, t = tf.Encoder(model), Tokenizer.from_str(model)
    assert e.pieces is not None
    assert e(words)[0].tolist() == [i for w in words for i in t.encode(w, add_special_tokens=False).ids]


def test_slices_keep_the_words():
    text = "ab cde " * 1000 + "x" * 50
    assert " ".join(tf.slices(text, 100)).split() == text.split() and max(map(len, tf.slices(text, 100))) < 160


def test_no_rows(spark, model):
    files = tf.write(table(spark, []), model, Scratch(spark, "t"))
    assert files.documents().count() == 0 and files.manifest.count() == 0 and len(files.ids(0, 10)) == 0


def test_query(spark):
    out = queries.op13_token_files(spark, "/root/testdata/sf0.001")
    assert [(f.name, f.dataType.simpleString()) for f in out.schema] == [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")]
    docs = [tuple(x) for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy(F.asc_nulls_first("doc_id")).collect()]
    want, at = [], 0
    for i, x in expected(queries.word_model(), docs):
        want.append((i, at, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        at += len(x)
    assert sorted(map(tuple, out.collect())) == want


def test_encoder_looks_words_up_once(model):
    """A part known as it stands is not prepared again, and known words of a batch with new ones not looked up again."""
    e = tf.Encoder(model)
    seen, part = [], e._part
    e._part = lambda p, ids, counts: seen.append(p) or part(p, ids, counts)
    first = e(["road, road; road. verge"])[0].tolist()
    assert seen == ["road", ",", ";", ".", "verge"]

    class Counted(dict):
        asked = 0

        def __getitem__(self, k):
            Counted.asked += 1
            return dict.__getitem__(self, k)

    e.words = Counted(e.words)
    again = e(["road, road; road. verge kerb"])[0].tolist()
    assert again[: len(first)] == first and Counted.asked == 1
