"""Removal of passages that repeat across documents, by windows that double in length.

A window is a sequence of consecutive words of one document. Every word gets a 128-bit hash, and two rolling polynomials over these
name any window without reading its words again. The first level takes windows of half the wanted length. Not all of them are
compared: among the half-length windows inside each full window the one of the smallest name stands for it (the first, if several
have it), and equal full windows have equal ones at the same place. Those names that stand in one document alone are done: no
full window around them can repeat. Around the others, the candidates, windows are extended to twice the length. Full windows next
to each other share their candidate: first the whole stretch that a candidate stands for is compared, so that of documents with the
same stretch only the first one's goes on, and then, where a candidate has several stretches, all of their full windows. No
candidate is left at the full length: a window whose words also start in an earlier document is removed, each word of it.

Rows are compared by hash and id alone. A frequent candidate, stretch or window is one row after partial aggregation; the join that
tells its documents so sends the few frequent ones to all tasks. Documents' texts are shuffled only where something repeats.

Null texts have no words. A null id comes after all others; rows of the same id don't count as each other's earlier one, and
repeated rows each give a row. An empty table gives none. Other columns aren't read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import met_by_key, pieces, sieve, sifted, sliced, stored
from folioscope.sources.corpus import durable

LEAST = 50
#: Words whose hashes a worker keeps, and windows that it names at once.
MEMORY, BLOCK = 300_000, 1 << 18
#: Stands for a null id.
LAST = (1 << 63) - 1
#: The bases of the two polynomials (odd numbers), and the mixer of names.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MIXER = np.uint64(0xD6E8FEB86659FD93)
#: Bits of a smallest name that say where it stands.
PLACE = np.uint64(BLOCK * 4 - 1)

SPANS = "array<struct<gram:long,stretch:binary,first:long,last:long>>"


class Names(dict):
    """The number of each word, and the words' hashes by number."""

    def __init__(self):
        self.hashes: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self.hashes)
        self.hashes.append(xxhash.xxh3_128_digest(word))
        return at

    def sequence(self, data: bytes) -> np.ndarray:
        return np.concatenate([np.fromiter(map(self.__getitem__, words), np.int64, len(words)) for words in map(bytes.split, pieces(data))])

    def hashed(self, numbers: np.ndarray) -> np.ndarray:
        return np.frombuffer(b"".join(self.hashes), np.uint64).reshape(-1, 2)[numbers]

    def trim(self) -> None:
        if len(self) > MEMORY:
            self.clear()
            self.hashes.clear()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIXER
    x = (x ^ (x >> np.uint64(32))) * MIXER
    return x ^ (x >> np.uint64(32))


@functools.cache
def powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.append(np.uint64(1), np.full(n - 1, base, np.uint64)))


class Rolled:
    """Names of windows of a sequence of word hashes (n, 2)."""

    def __init__(self, hashes: np.ndarray, n: int):
        """n: at least len(hashes)."""
        self.inverse = [powers(pow(b, -1, 1 << 64), n + 1) for b in BASES]
        self.sums = [np.append(np.uint64(0), np.cumsum(hashes[:, i] * powers(b, n + 1)[: len(hashes)], dtype=np.uint64)) for i, b in enumerate(BASES)]

    def half(self, i: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[i][stop] - self.sums[i][start]) * self.inverse[i][start])

    def names(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return np.stack([self.half(i, start, stop) for i in range(2)], 1)


def least_of_runs(x: np.ndarray, run: int) -> np.ndarray:
    """The minimum of every `run` consecutive numbers: of the rest of a block and the beginning of the next one."""
    n = len(x) - run + 1
    blocks = np.append(x, np.full(-len(x) % run, np.iinfo(np.uint64).max, np.uint64)).reshape(-1, run)
    begun = np.minimum.accumulate(blocks, 1).ravel()
    rest = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(rest[:n], begun[run - 1 : run - 1 + n])


def binary(names: np.ndarray) -> pa.Array:
    """16 bytes of each name (n, 2)."""
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(names), [None, pa.py_buffer(np.ascontiguousarray(names).tobytes())]).cast(pa.binary())


def blocks_of(numbers: list[np.ndarray], names: Names, least: int) -> Iterator[tuple[int, int, Rolled, np.ndarray]]:
    """(first word, words, names, where windows may start) of blocks of the texts' sequences, one after the other. Blocks overlap, so that
    each window of `least` words, all within one text, starts in one block and lies in it."""
    sizes = np.array([len(n) for n in numbers], np.int64)
    every, ends = np.concatenate(numbers), np.cumsum(sizes)
    free = np.repeat(ends, sizes) - np.arange(len(every)) >= least
    for at in range(0, len(every), BLOCK):
        starts = np.flatnonzero(free[at : at + BLOCK])
        if len(starts):
            own = every[at : at + BLOCK + least]
            yield at, len(own), Rolled(names.hashed(own), BLOCK + least), starts


def stretches(numbers: list[np.ndarray], names: Names, least: int) -> tuple[np.ndarray, ...]:
    """(text, gram, stretch's name (n, 2), first and last full window) of the candidates of these texts: neighbouring full windows
    that the same half-length window stands for, and its name, the gram."""
    half, out = (least + 1) // 2, []
    ends = np.cumsum([len(n) for n in numbers])
    for at, size, rolled, starts in blocks_of(numbers, names, least):
        where = np.arange(size - half + 1)
        grams = rolled.half(0, where, where + half)
        lowest = least_of_runs(grams & ~PLACE | where.astype(np.uint64), least - half + 1)[starts] & PLACE
        lowest = lowest.astype(np.int64)
        text = np.searchsorted(ends, at + starts, "right")
        new = np.append(True, (np.diff(lowest) != 0) | (np.diff(text) != 0))
        first, last = starts[new], starts[np.append(new[1:], True)]
        out.append((text[new], grams[lowest[new]], rolled.names(first, last + least), at + first, at + last))
    if not out:
        return tuple(np.zeros(s, t) for s, t in ((0, np.int64), (0, np.uint64), ((0, 2), np.uint64), (0, np.int64), (0, np.int64)))
    text, gram, name, first, last = map(np.concatenate, zip(*out))
    begin = np.append(0, ends)[text]
    return text, gram, name, first - begin, last - begin


def digest(parts: Iterator[list[bytes]]) -> str:
    """sha256 of all words of the lists joined by single spaces."""
    out, some = hashlib.sha256(), False
    for words in parts:
        if words:
            out.update(b" " * some + b" ".join(words))
            some = True
    return out.hexdigest()


def _candidates(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each row (doc_id, id, at, text) the number of words, their digest and the candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names()
        for batch, texts in sliced(batches, 3):
            numbers = [names.sequence(t) for t in texts]
            text, gram, name, first, last = stretches(numbers, names, least)
            each = pa.StructArray.from_arrays([pa.array(gram.view(np.int64)), binary(name), pa.array(first), pa.array(last)], ["gram", "stretch", "first", "last"])
            offsets = np.searchsorted(text, np.arange(len(texts) + 1))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), each)
            whole = [digest(map(bytes.split, pieces(t))) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([len(n) for n in numbers], pa.int64()), pa.array(whole), lists], ["doc_id", "id", "at", "n_words", "digest", "spans"])
            names.trim()

    return run


def _full_windows(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The full windows (name, id, at, first) that rows (id, at, text, firsts, lasts) ask for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names()
        for batch, texts in sliced(batches, 2):
            numbers = [names.sequence(t) for t in texts]
            begin = np.append(0, np.cumsum([len(n) for n in numbers]))
            asked = np.zeros(begin[-1], bool)
            for i in range(len(texts)):
                for a, b in zip(*(np.asarray(batch.column(c)[i].values) for c in (3, 4))):
                    asked[begin[i] + a : begin[i] + b + 1] = True
            for at, _, rolled, starts in blocks_of(numbers, names, least):
                starts = starts[asked[at + starts]]
                if len(starts):
                    text = np.searchsorted(begin[1:], at + starts, "right")
                    ids = [batch.column(c).take(pa.array(text)) for c in (0, 1)]
                    yield pa.RecordBatch.from_arrays([binary(rolled.names(starts, starts + least)), *ids, pa.array(at + starts - begin[text])], ["name", "id", "at", "first"])
            names.trim()

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of rows (doc_id, text, firsts, ends) without the words from each first to before its end."""
    for batch, texts in sliced(batches, 1):
        rows = []
        for i, text in enumerate(texts):
            spans = [np.asarray(batch.column(c)[i].values) for c in (2, 3)]
            total, out = 0, 0

            def left() -> Iterator[list[bytes]]:
                nonlocal total, out
                change = np.zeros(int(spans[1].max()) + 1, np.int32)
                np.add.at(change, spans[0], 1)
                np.add.at(change, spans[1], -1)
                gone = np.cumsum(change) > 0
                for piece in pieces(text):
                    words = piece.split()
                    own = np.zeros(len(words), bool)
                    part = gone[total : total + len(words)]
                    own[: len(part)] = part
                    total, out = total + len(words), out + int(own.sum())
                    yield [w for w, x in zip(words, own.tolist()) if not x]

            kept = digest(left())
            rows.append((total, out, kept))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string())))], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, id, at, text): id stands for the row's place in the order, at for its text."""
    own = F.col("doc_id").cast("long")
    return docs.select(own.alias("doc_id"), F.coalesce(own, F.lit(LAST)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("at"), "text")


def _texts_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """rows joined to wanted(id, at, ...); texts that the sieve shows not to be among them aren't shuffled."""
    return sifted(rows, "at", sieve(wanted, "at")).where("_maybe").drop("_maybe").join(wanted, ["id", "at"])


def _repeated(rows: DataFrame, docs: DataFrame, least: int) -> DataFrame:
    """(id, at, first, end) of stretches and windows that are to go, of docs(doc_id, id, at, text) and their candidates
    rows(id, at, spans)."""
    each = rows.where(F.size("spans") > 0).select("id", "at", F.inline("spans"))
    grams = each.groupBy("gram").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("n"))
    grams = durable(grams.where("low < high").select("gram", "n"))
    held = sifted(each, "gram", sieve(grams, "gram")).where("_maybe").drop("_maybe")
    held = durable(met_by_key(held, grams, "gram", "n"))
    by_stretch = durable(held.groupBy("stretch").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")))
    met = met_by_key(held, by_stretch, "stretch", "n")
    whole = met.where("id > least").select("id", "at", "first", (F.col("last") + least).alias("end"))
    several = held.groupBy("gram", "stretch").agg(F.lit(1).alias("x")).groupBy("gram").agg(F.count("x").alias("n")).where("n > 1")
    first = met_by_key(met.where("id = least"), durable(several), "gram", "n")
    asked = durable(first.groupBy("id", "at").agg(F.collect_list("first").alias("firsts"), F.collect_list("last").alias("lasts")))
    texts = _texts_of(docs, asked).select("id", "at", "text", "firsts", "lasts")
    windows = durable(texts.mapInArrow(_full_windows(least), "name binary, id long, at long, first long"))
    again = windows.groupBy("name").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count(F.lit(1)).alias("n"))
    again = durable(again.where("least < most").select("name", "least", "n"))
    met = met_by_key(windows, again, "name", "n").where("id > least")
    return whole.union(met.select("id", "at", "first", (F.col("first") + least).alias("end")))


def without_repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row of docs(doc_id, text): words of windows of `least` words that also
    start in a document of a smaller id are removed."""
    rows = _rows(docs)
    marked = stored(rows.mapInArrow(_candidates(least), f"doc_id long, id long, at long, n_words long, digest string, spans {SPANS}"), "repeats")
    gone = _repeated(marked.select("id", "at", "spans"), rows, least).groupBy("id", "at")
    gone = durable(gone.agg(F.collect_list("first").alias("firsts"), F.collect_list("end").alias("ends")))
    clean = marked.join(gone.select("id", "at"), ["id", "at"], "left_anti")
    clean = clean.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("digest").alias("kept_sha256"))
    cut = _texts_of(rows, gone).select("doc_id", "text", "firsts", "ends").mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    return clean.unionByName(cut)
