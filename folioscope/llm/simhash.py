"""SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprints that differ in at most three of 64 bits are linked. Candidates come from fuzzy keys: the fingerprint is four
segments of 16 bits, of which three differing bits leave at least one untouched, and always one untouched segment such
that at most two of the differing bits lie in the 23 bits after it (cyclically). A key is that segment's bits with the
index of a codeword of the perfect (23, 12) Golay code at distance four or less from the following 23 bits. A word has one
such codeword or six, and any two words that differ in at most two bits have one in common, so linked fingerprints always
share a key. Fingerprints that share a key are then verified bit by bit, and what is kept of a key's links is a spanning
forest. Exact copies meet in one fingerprint before any of this; components follow from distributed star rounds.

Nulls count as empty texts; empty texts have fingerprint zero, linked like any other. A null doc_id never names a
component unless its members have no other id. Repeated rows each give a row; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import alone, durable, met_by_key, sieve, sifted, sized_batches, whole_keys
from folioscope.llm.components import below

SEED, BITS = 42, 3
#: Fixed value: the generator polynomial of the Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
#: Groups of more fingerprints are split by untouched blocks of their remaining bits before pairs are compared.
COMPARED = 2048

_lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingles(text: str, width: int = 3) -> list[bytes]:
    """Space-joined runs of `width` words, repeats included; of fewer words the whole sequence; of none nothing."""
    words = text.encode().translate(_lower).split()  # for bytes, white space is exactly 0x20 and 0x09 to 0x0D
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(width)))))


def fingerprint(text: str, width: int = 3, seed: int = SEED) -> int:
    """A bit is 1 if it's set in over half of the shingles' hashes."""
    return print_of(np.array([xxhash.xxh64_intdigest(s, seed) for s in shingles(text, width)], np.uint64))


def print_of(hashes: np.ndarray) -> int:
    """The fingerprint of shingles with these hashes."""
    parts = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for start in range(0, len(parts), 65536):
        ones += np.unpackbits(parts[start : start + 65536], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def syndromes(words: np.ndarray) -> np.ndarray:
    """The remainder of 23-bit words by the generator: 0 for codewords."""
    rest = words.astype(np.int64)
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


def near_errors() -> np.ndarray:
    """By syndrome, the error patterns of weight four at most that have it: one, or six; the rows are filled with the first."""
    bits = [1 << i for i in range(23)]
    single = syndromes(np.array(bits))
    found: list[list[int]] = [[] for _ in range(2048)]
    found[0].append(0)
    for a in range(23):
        found[single[a]].append(bits[a])
        for b in range(a):
            found[single[a] ^ single[b]].append(bits[a] | bits[b])
            for c in range(b):
                found[single[a] ^ single[b] ^ single[c]].append(bits[a] | bits[b] | bits[c])
                for d in range(c):
                    found[single[a] ^ single[b] ^ single[c] ^ single[d]].append(bits[a] | bits[b] | bits[c] | bits[d])
    return np.array([x + [x[0]] * (6 - len(x)) for x in found], np.int64)


_errors: list[np.ndarray] = []


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the fingerprint, key) of every key of the fingerprints (unsigned 64-bit)."""
    if not _errors:
        _errors.append(near_errors())
    at, keys = [], []
    for segment in range(4):
        turned = prints << np.uint64(16 * segment) | prints >> np.uint64((64 - 16 * segment) % 64) if segment else prints
        exact = (turned >> np.uint64(48)).astype(np.int64)
        word = (turned >> np.uint64(25)).astype(np.int64) & 0x7FFFFF
        code = (word[:, None] ^ _errors[0][syndromes(word)]) >> 11
        once = np.append(np.ones((len(code), 1), bool), code[:, 1:] != code[:, :1], axis=1)
        at.append(np.repeat(np.arange(len(prints)), once.sum(1)))
        keys.append(((segment << 28) | (exact << 12))[:, None].repeat(6, 1)[once] | code[once])
    return np.concatenate(at), np.concatenate(keys)


class Forest:
    """Union-find over array places."""

    def __init__(self, size: int):
        self.up = list(range(size))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def links(prints: np.ndarray, bits: int = BITS, left: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places of all pairs within `bits` differing bits, in parts. A large group is split by bits + 1 blocks of its
    lowest `left` bits, one of which every such pair has in common."""
    if len(prints) <= COMPARED or left < bits + 1:
        step = max(1, 4_000_000 // max(1, len(prints)))
        for start in range(0, len(prints), step):
            a, b = np.nonzero(np.bitwise_count(prints[start : start + step, None] ^ prints[None, :]) <= bits)
            a += start
            yield a[a < b], b[a < b]
        return
    width = left // (bits + 1)
    for block in range(bits + 1):
        mine = (prints >> np.uint64(block * width)) & np.uint64((1 << width) - 1)
        order = np.argsort(mine, kind="stable")
        cuts = np.flatnonzero(np.diff(mine[order])) + 1
        for group in np.split(order, cuts):
            if len(group) > 1:  # the block is alike in all, so only the other bits are left to tell them apart
                low = prints[group] & np.uint64((1 << block * width) - 1)
                rest = (prints[group] >> np.uint64((block + 1) * width)) << np.uint64(block * width) | low
                for a, b in links(rest, bits, left - width):
                    yield group[a], group[b]
        if not len(cuts):  # all pairs are alike in this block
            return


def forest_links(prints: np.ndarray) -> np.ndarray:
    """Pairs of prints that span the components of one key's group."""
    forest, kept = Forest(len(prints)), []
    for a, b in links(prints):
        kept += [(x, y) for x, y in zip(a.tolist(), b.tolist()) if forest.join(x, y)]
    return prints[np.array(kept, np.int64).reshape(-1, 2)]


@alone("simhash")
def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column(0).to_numpy()
        at, keys = fuzzy_keys(prints.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(prints[at])], ["key", "print"])


@alone("simhash")
def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (_, prints), starts in whole_keys(batches):
        unsigned, ends = prints.view(np.uint64), np.append(starts[1:], len(prints))
        two = starts[ends - starts == 2]
        near = two[np.bitwise_count(unsigned[two] ^ unsigned[two + 1]) <= BITS]
        found = [np.stack([unsigned[near], unsigned[near + 1]], 1)]
        found += [forest_links(unsigned[a:b]) for a, b in zip(starts[ends - starts > 2], ends[ends - starts > 2])]
        pairs = np.concatenate(found).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def fingerprints(docs: DataFrame, width: int = 3, mark: Column | None = None) -> DataFrame:
    """(doc_id, print) of every row of docs(doc_id, text); print holds the 64 bits as a signed integer. With a mark, that
    column of the row too, as hash."""
    more = [] if mark is None else [mark.alias("hash")]

    @alone("simhash")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t or "", width) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints), *batch.columns[2:]], ["doc_id", "print", *batch.schema.names[2:]])

    rows = sized_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *more))
    return rows.mapInArrow(run, "doc_id long, print long" + ", hash long" * len(more))


def print_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) that span the components of distinct fingerprints: all pairs within three bits follow from them."""
    keyed = prints.select("print").mapInArrow(_emit_keys, "key long, print long")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_verify, "a long, b long").distinct()


def _components(marked: DataFrame) -> DataFrame:
    """(print, root, component_id, n) of every distinct fingerprint of marked(doc_id, print), with its number of rows."""
    prints = durable(marked.groupBy("print").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    roots = below(print_links(prints))
    named = prints.join(roots, prints["print"] == roots["node"], "left").select("print", F.coalesce("root", "print").alias("root"), "first", "n")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return durable(named.join(least, "root").select("print", "root", "component_id", "n"))


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs: component_id is the smallest doc_id that links reach."""
    marked = durable(fingerprints(docs, width))
    met = met_by_key(marked, _components(marked), "print", "n")
    return met.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def earliest() -> Column:
    """Of rows (doc_id, hash) the one that stays of a group."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash"))


def one_of_each(docs: DataFrame, width: int = 3) -> DataFrame:
    """One row of docs(doc_id, text, ...) of each component, all columns kept: of the smallest doc_id (nulls last), then of
    the text with the smallest hash; of rows alike in both, any one."""
    text = F.coalesce("text", F.lit(""))
    marked = durable(fingerprints(docs.select("doc_id", "text"), width, F.xxhash64(text)))
    first = marked.groupBy("print").agg(earliest().alias("x"))
    return one_of_root(docs, marked, first.join(_components(marked), "print"))


def one_of_root(docs: DataFrame, rows: DataFrame, first: DataFrame) -> DataFrame:
    """The row of docs that one_of_each keeps of each root; rows(doc_id, hash) are those of docs, first(root, x) the earliest of
    each part of a root."""
    kept = first.groupBy("root").agg(F.min("x").alias("x")).select(F.col("x.doc_id").alias("_id"), F.col("x.hash").alias("_text_hash"), F.lit(True).alias("_kept"))
    keys = rows.groupBy("doc_id", "hash").agg(F.count(F.lit(1)).alias("_rows"))
    keys = keys.join(kept.distinct(), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_text_hash")), "left")
    # rows that share doc_id and text with no other one, and stay, are sure; the others, and what the sieve takes for one, meet
    doubtful = keys.where("_kept is null or _rows > 1").select(F.xxhash64("doc_id", "hash").alias("_key"), F.col("doc_id").alias("_id"), F.col("hash").alias("_text_hash"), "_kept", "_rows")
    doubtful = durable(doubtful)
    # the caller's columns stay in one, so that none can clash with those here
    rows = docs.select(F.struct("*").alias("row"))
    rows = rows.withColumns({"_own_id": F.col("row.doc_id").cast("long"), "_hash": F.xxhash64(F.coalesce("row.text", F.lit("")))}).withColumn("_own", F.xxhash64("_own_id", "_hash"))
    rows = sifted(rows, "_own", sieve(doubtful, "_key"))
    same = (F.col("_own") == F.col("_key")) & F.col("_own_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_text_hash"))
    met = rows.where("_maybe").join(doubtful.hint("shuffle_hash"), same, "left").where("_key is null or _kept")
    alike = Window.partitionBy("_key", "_id", "_text_hash").orderBy(F.lit(0))
    once = met.where("_rows > 1").withColumn("_number", F.row_number().over(alike)).where("_number = 1")
    return rows.where("not _maybe").select("row").union(met.where("_key is null").select("row")).union(once.select("row")).select("row.*")
