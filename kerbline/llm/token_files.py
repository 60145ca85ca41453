"""Token ids of whole texts in files of bit-plane shuffled blocks.

Texts are put in order of their id by a range shuffle; each task encodes its range and streams the ids to one file.
A file is, in this order: the magic; blocks of ``BLOCK`` ids (the last one shorter), each cut into planes (plane k
holds byte k, or bit k, of every id) and each plane compressed with zstandard, a plane of zeros being left out; blocks
of document ids and lengths; a JSON footer, the chunk index (place and plane lengths of every block); the footer's
length; the magic again. Ids of a range are read by decoding the blocks that hold them and no others.

Files are named after the task attempt that wrote them, and only the files of attempts that Spark committed are in the
manifest, so a lost executor leaves at most a file that nothing names.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbline.llm.common import partitions
from kerbline.scratch import Scratch

MAGIC, BLOCK, DOCS, END_ID = b"KIDPLANE", 1 << 16, 1 << 16, 1
#: Characters encoded at once, and words whose ids a worker remembers.
SLICE, REMEMBERED = 1 << 20, 1 << 19
MANIFEST = "part int, file string, n_ids long, n_docs long, n_bytes long"
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"


# --- planes -----------------------------------------------------------------------------------


def to_planes(ids: np.ndarray, unit: str) -> list[bytes]:
    """The four byte planes or 32 bit planes of unsigned 32-bit ids, lowest first."""
    rows = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if unit == "byte":
        return [rows[:, k].tobytes() for k in range(4)]
    return [np.packbits((rows[:, k // 8] >> (k % 8)) & 1).tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, unit: str) -> np.ndarray:
    """The ids again; an empty plane is all zeros."""
    rows = np.zeros((n, 4), np.uint8)
    for k, plane in enumerate(planes):
        if plane and unit == "byte":
            rows[:, k] = np.frombuffer(plane, np.uint8)
        elif plane:
            rows[:, k // 8] |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n) << (k % 8)
    return rows.reshape(-1).view("<u4")


# --- one file ---------------------------------------------------------------------------------


class Writer:
    """Appends documents to one open stream; holds one block of ids and one of documents."""

    def __init__(self, out, unit: str = "byte", block: int = BLOCK):
        self.out, self.unit, self.block = out, unit, block
        self.pack = zstandard.ZstdCompressor(level=3).compress
        self.blocks, self.docs = [], []
        self.at = self.n_ids = self.n_docs = 0
        self.waiting, self.held = [], 0
        self.ids, self.lengths = [], []
        self._put(MAGIC)

    def _put(self, data: bytes) -> int:
        self.out.write(data)
        self.at += len(data)
        return len(data)

    def _block(self, ids: np.ndarray) -> None:
        at = self.at
        self.blocks.append([at, [self._put(self.pack(p)) if any(p) else 0 for p in to_planes(ids, self.unit)]])

    def add(self, ids: np.ndarray) -> None:
        """Ids of the document that ``end`` will close, all or some."""
        self.waiting.append(ids)
        self.held += len(ids)
        self.n_ids += len(ids)
        if self.held >= self.block:
            flat = np.concatenate(self.waiting)
            whole = len(flat) - len(flat) % self.block
            for i in range(0, whole, self.block):
                self._block(flat[i : i + self.block])
            self.waiting, self.held = [flat[whole:]], len(flat) - whole

    def end(self, doc_id: int | None, length: int) -> None:
        self.ids.append(doc_id)
        self.lengths.append(length)
        self.n_docs += 1
        if len(self.ids) == DOCS:
            self._docs()

    def _docs(self) -> None:
        at, none = self.at, np.array([i is None for i in self.ids])
        ids = np.array([0 if i is None else i for i in self.ids], "<i8")
        parts = (ids.tobytes(), np.array(self.lengths, "<i8").tobytes(), np.packbits(none).tobytes())
        self.docs.append([at, len(ids), [self._put(self.pack(p)) for p in parts]])
        self.ids, self.lengths = [], []

    def close(self) -> None:
        if self.held:
            self._block(np.concatenate(self.waiting))
        if self.ids:
            self._docs()
        footer = json.dumps({"unit": self.unit, "block": self.block, "ids": self.n_ids, "blocks": self.blocks, "docs": self.docs}).encode()
        self._put(footer + len(footer).to_bytes(8, "little") + MAGIC)


class Reader:
    """Reads an open, seekable file by its chunk index."""

    def __init__(self, f, size: int):
        self.f, self.unpack = f, zstandard.ZstdDecompressor().decompress
        if size < 24 or self._at(size - 8, 8) != MAGIC:
            raise ValueError("not a file of token ids, or cut short")
        n = int.from_bytes(self._at(size - 16, 8), "little")
        self.index = json.loads(self._at(size - 16 - n, n))

    def _at(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        return self.f.read(n)

    def _parts(self, at: int, lengths: list[int]) -> list[bytes]:
        data, out, done = self._at(at, sum(lengths)), [], 0
        for n in lengths:
            out.append(self.unpack(data[done : done + n]) if n else b"")
            done += n
        return out

    def block(self, k: int) -> np.ndarray:
        x = self.index
        n = min(x["block"], x["ids"] - k * x["block"])
        return from_planes(self._parts(*x["blocks"][k]), n, x["unit"])

    def ids(self, first: int, n: int) -> np.ndarray:
        """Ids ``first`` to ``first + n`` of the file; only their blocks are decoded."""
        size = self.index["block"]
        if n <= 0:
            return np.zeros(0, "<u4")
        found = np.concatenate([self.block(k) for k in range(first // size, (first + n - 1) // size + 1)])
        return found[first % size : first % size + n]

    def documents(self) -> Iterator[tuple[int | None, int]]:
        """Id and number of token ids of each document, in order."""
        for at, n, lengths in self.index["docs"]:
            ids, counts, none = self._parts(at, lengths)
            absent = np.unpackbits(np.frombuffer(none, np.uint8), count=n)
            for i, c, a in zip(np.frombuffer(ids, "<i8").tolist(), np.frombuffer(counts, "<i8").tolist(), absent.tolist(), strict=True):
                yield (None if a else i), c

    def checksums(self) -> Iterator[tuple[int | None, int, int, int]]:
        """Document id, first place, length and CRC-32 of its ids; one decoded block is held at a time."""
        held, at, size, start = np.zeros(0, "<u4"), -1, self.index["block"], 0
        for doc, n in self.documents():
            crc, done = 0, 0
            while done < n:
                k, inside = divmod(start + done, size)
                if k != at:
                    held, at = self.block(k), k
                part = held[inside : inside + n - done]
                crc, done = zlib.crc32(part.tobytes(), crc), done + len(part)
            yield doc, start, n, crc
            start += n


# --- encoding ---------------------------------------------------------------------------------

#: Latin letters, and marks that follow them. No apostrophe, which the splitter treats by what follows it.
SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?()\[\]{}*+=/#%&$@_-]*)")
#: What a model does before its merges, for words of that kind: lower-case, split letters, digits and other marks.
PLAIN_STEPS = (
    ["NFC", "Replace", "Lowercase"],
    ["Split", "ByteLevel"],
    r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
)


def _plain_steps(model: str) -> bool:
    steps = json.loads(model)
    before, split = ((steps.get(k) or {}) for k in ("normalizer", "pre_tokenizer"))
    first, second = before.get("normalizers", []), split.get("pretokenizers", [])
    return ([x["type"] for x in first], [x["type"] for x in second], second[0]["pattern"].get("Regex") if second and "pattern" in second[0] else None) == PLAIN_STEPS


def _byte_letters() -> dict[int, str]:
    """What byte-level models write for the Latin letters beyond ASCII: a sign for each byte of their UTF-8, which is
    the byte's own character where that is printable, and the next free one from 256 on elsewhere."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(256, 512))
    sign = {b: chr(b) if b in own else chr(next(free)) for b in range(256)}
    return {c: "".join(sign[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


class Encoder:
    """Ids of whole texts by a ``tokenizers`` model that drops white space.

    Such a model never joins words across white space, so a text's ids are those of its words, one after another.
    A worker keeps the ids of the words it has seen (a bounded number) and hands new ones to the library together.
    Where the model lower-cases and splits letters from marks, as ``PLAIN_STEPS`` says, a word of Latin letters, with
    or without marks behind it, goes to the library's model as these two parts, past its normaliser and splitter, which
    would give the same parts; all other words take the whole way.
    """

    def __init__(self, model: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.pieces = self.tokenizer.model.tokenize if _plain_steps(model) else None
        self.letters = _byte_letters()
        self._forget()

    def _forget(self, parts: bool = True) -> None:
        if parts:
            self.parts: dict[str, int] = {"": 0}
            self.part_ids = _Lists()
        self.words, self.word_ids = {"": 0}, _Lists()

    def _part(self, part: str, ids: list[int], counts: list[int]) -> int:
        low = part.lower()
        at = self.parts.get(low)
        if at is None:
            at = self.parts[low] = len(self.part_ids) + len(counts)
            found = [t.id for t in self.pieces(low if low.isascii() else low.translate(self.letters))]
            ids += found
            counts.append(len(found))
        return at

    def _learn(self, new: list[str], forget: bool = True) -> None:
        if forget and len(self.words) + len(new) > REMEMBERED:
            self._forget(parts=len(self.parts) > REMEMBERED)
        easy, hard, parts, ids, counts = [], [], [], [], []
        at = self.parts.get
        for w in new:
            m = SIMPLE.fullmatch(w) if self.pieces else None
            if m:
                easy.append(w)
                for part in m.groups():  # most are known as they stand
                    k = at(part)
                    parts.append(self._part(part, ids, counts) if k is None else k)
            else:
                hard.append(w)
        self.part_ids.add(ids, counts)
        flat, n = self.part_ids.of(np.array(parts, np.int64))
        self.word_ids.add(flat, n.reshape(-1, 2).sum(axis=1))
        if hard:
            found = self.tokenizer.encode(hard, is_pretokenized=True, add_special_tokens=False)
            self.word_ids.add(found.ids, np.bincount(np.array(found.word_ids, np.int64), minlength=len(hard)))
        self.words.update(zip(easy + hard, range(len(self.words), len(self.words) + len(new)), strict=True))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and their number in each text."""
        split = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        words = list(chain.from_iterable(split))
        known = np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(known < 0)
        if len(unknown):
            met = [words[i] for i in unknown.tolist()]
            before = self.words
            self._learn(list(dict.fromkeys(met)))
            if self.words is not before:  # forgotten on the way: the rest of the batch is learnt again
                self._learn([w for w in dict.fromkeys(words) if w not in self.words], forget=False)
                known = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
            else:
                known[unknown] = np.fromiter(map(self.words.__getitem__, met), np.int64, len(met))
        flat, counts = self.word_ids.of(known)
        bounds = np.concatenate([[0], np.cumsum(counts)])[np.cumsum([0] + [len(s) for s in split])]
        return flat, np.diff(bounds)


class _Lists:
    """A growing sequence of lists of ids in flat arrays; list 0 is empty."""

    def __init__(self):
        self.flat, self.first, self.count = np.zeros(0, "<u4"), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def __len__(self) -> int:
        return len(self.count)

    def add(self, ids, counts) -> None:
        counts = np.asarray(counts, np.int64)
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(counts) - counts])
        self.count = np.concatenate([self.count, counts])
        self.flat = np.concatenate([self.flat, np.asarray(ids, "<u4")])

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of these numbers, one after another, and the length of each."""
        counts = self.count[numbers]
        ends = np.cumsum(counts)
        place = np.repeat(self.first[numbers] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)
        return self.flat[place], counts


_encoders: dict[int, Encoder] = {}


def encoder(model: str) -> Encoder:
    """The worker's own encoder of this model, kept between tasks."""
    key = zlib.crc32(model.encode())
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(model)
    return _encoders[key]


def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """Pieces of a text of about ``size`` characters, cut at blanks."""
    start = 0
    while len(text) - start > size:
        cut = text.find(" ", start + size)
        if cut < 0:
            break
        yield text[start:cut]
        start = cut + 1
    yield text[start:]


# --- the distributed job ----------------------------------------------------------------------


@dataclass
class TokenFiles:
    """A folder of files and its manifest: one row per file, in order, with the ids before it (``start``)."""

    folder: str
    manifest: DataFrame

    def documents(self) -> DataFrame:
        """``doc_id, start, n_tokens, ids_crc32`` of every document, read back from the files, each by one task."""
        folder = self.folder

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            fs, root = _store(folder)
            for f in frames:
                for name, base in zip(f["file"], f["start"], strict=True):
                    path = f"{root}/{name}"
                    with fs.open_input_file(path) as stream:
                        rows = []
                        for doc, start, n, crc in Reader(stream, stream.size()).checksums():
                            rows.append((doc, base + start, n, crc))
                            if len(rows) == DOCS:
                                yield _rows(rows)
                                rows = []
                        yield _rows(rows)

        return self.manifest.select("file", "start").repartition(partitions(self.manifest)).mapInPandas(run, RESULT)

    def ids(self, first: int, n: int) -> np.ndarray:
        """Ids ``first`` to ``first + n`` of the whole corpus, for a bounded ``n``: only their blocks are read."""
        fs, root = _store(self.folder)
        near = self.manifest.where((F.col("start") < first + n) & (F.col("start") + F.col("n_ids") > first)).orderBy("part")
        out = [np.zeros(0, "<u4")]
        for r in near.collect():
            with fs.open_input_file(f"{root}/{r['file']}") as f:
                a, b = max(0, first - r["start"]), min(r["n_ids"], first + n - r["start"])
                out.append(Reader(f, f.size()).ids(a, b - a))
        return np.concatenate(out)


def _rows(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"]).astype({"doc_id": "Int64"})


def _store(folder: str):
    """The file system of a folder that driver and executors share, by its URI or absolute path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write(docs: DataFrame, model: str, scratch: Scratch, end_id: int = END_ID, unit: str = "byte", block: int = BLOCK) -> TokenFiles:
    """Encode ``docs`` (doc_id, text) with the ``tokenizers`` model text ``model`` and write the ids in order of doc_id.

    ``end_id`` closes each document; a null or empty text has that id alone. Rows without an id come first; repeated
    ids are ordered by a hash of their text. Repeated rows are written as often as they occur. Other columns are left
    alone. No rows: no files and an empty manifest. The model travels with the task, so executors need no copy of it.
    """
    folder = f"{scratch.folder}/files"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here = TaskContext.get()
        fs, root = _store(folder)
        name = f"part-{here.partitionId():06d}-{here.taskAttemptId()}.ids"
        out = None
        encode = encoder(model)
        for f in frames:
            if out is None:
                fs.create_dir(root, recursive=True)
                stream = fs.open_output_stream(f"{root}/{name}")
                out = Writer(stream, unit, block)
            for doc, ids in _encoded(f, encode, end_id):
                for part in ids:
                    out.add(part)
                out.end(doc, sum(len(p) for p in ids))
        if out is not None:
            out.close()
            stream.close()
            yield pd.DataFrame([(here.partitionId(), name, out.n_ids, out.n_docs, out.at)], columns=["part", "file", "n_ids", "n_docs", "n_bytes"])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("_h"), F.monotonically_increasing_id().alias("_n"))
    order = [F.asc_nulls_first("doc_id"), "_h", "_n"]
    sorted_ = rows.repartitionByRange(partitions(docs), *order).sortWithinPartitions(*order).select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    files = scratch.table(sorted_.mapInPandas(run, MANIFEST), "manifest")
    # one row per file
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return TokenFiles(folder, scratch.table(files.withColumn("start", F.coalesce(before, F.lit(0).cast("long"))), "index"))


def _encoded(f: pd.DataFrame, encode: Encoder, end_id: int) -> Iterator[tuple[int | None, list[np.ndarray]]]:
    """Each row's id and its token ids, in parts; short texts are encoded together."""
    end = np.array([end_id], "<u4")
    ids, texts = f["doc_id"].tolist(), f["text"].tolist()
    start = held = 0
    for i, t in enumerate([*texts, None]):
        long = t is not None and len(t) > SLICE
        if t is None or long or held > SLICE:
            flat, counts = encode(texts[start:i]) if i > start else (None, [])
            at = 0
            for doc, n in zip(ids[start:i], counts, strict=True):
                yield (None if doc is None else int(doc)), [flat[at : at + n], end]
                at += n
            start, held = i, 0
        if long:
            yield (None if ids[i] is None else int(ids[i])), [*(encode([s])[0] for s in slices(t)), end]
            start = i + 1
        elif t is not None:
            held += len(t) + 1
