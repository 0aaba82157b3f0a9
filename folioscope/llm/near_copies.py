"""Operator 9's near copies made exact: its fuzzy keys on five-word fingerprints, and prefixes for what they can't reach.

Two texts are linked if the sets of their five-word shingles have a Jaccard similarity of 0.8 or more. Texts with the same
set meet in one node before anything else. Candidates are the pairs that the Golay keys of simhash.py find, and, since most
such texts' fingerprints differ in more than three bits, those that prefixes give: with all shingles in one fixed order, two
such sets of n shingles have one in common among the first n - ceil(0.8 n) + 1 of each, so no pair is missed. The order is by
hash, with shingles that a sample of the texts often has at the end, so that common lines stay out of most prefixes; any order
gives the same links.

The nodes that fuzzy keys link, and of the nodes of one shingle those with one of them, its lead, are compared first; then, in rounds
with the components that this gives, of each node and shingle the pairs with the nearest sketches in other ones, so that two large
components that belong together don't meet in all their pairs; at last all pairs that still are in different ones. Pairs are left out by size, by what the rest of both sets can still hold and by
sketches: of 512 bits, or as many as the text has shingles, each shingle flips one, and two sets differ in as many shingles at
least as their bits do. The others are verified on their texts. Links and their components so are those of all pairs.

Nulls count as empty texts; empty texts are alike. A text of fewer words is one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import alone, durable, gathered, sieve, sifted, sized_batches, whole_keys
from folioscope.llm.components import below
from folioscope.llm.simhash import earliest, one_of_root, print_links, print_of, shingles

WIDTH = 5
#: The least similarity, as a quotient of whole numbers.
SIMILAR, OF = 4, 5
#: Of the texts, one of so many is looked at for common shingles; those that as many of them have come last in the order.
SAMPLED, COMMON, MOST_COMMON = 16, 4, 200_000
#: Orders in which a shingle's lead may be chosen, and how many pairs of a text go to one task's row group.
LEADS, ROUTED = 4, 64
#: How often components meet by their nearest nodes, at most, before all pairs across them are looked at.
ROUNDS = 2
PARITIES = [f"x{i}" for i in range(8)]
_MIXER = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str) -> np.ndarray:
    """The hashes of a text's distinct shingles, in ascending order."""
    return np.unique(np.array([xxhash.xxh64_intdigest(s) for s in shingles(text, WIDTH)], np.uint64))


def node_of(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes())).view(np.int64))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """512 bits, or the power of 2 that isn't less than the shingles (2^24 at most): of each bit, whether an odd number of them
    falls on it."""
    bits = 512
    while bits < min(len(hashes), 1 << 24):
        bits *= 2
    odd = np.bincount((hashes >> np.uint64(40)).astype(np.int64) % bits, minlength=bits) % 2
    return np.packbits(odd.astype(np.uint8))


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """The sketch of so many bytes that a longer sketch holds."""
    return np.bitwise_xor.reduce(bits.reshape(-1, size))


def parities(hashes: np.ndarray) -> np.ndarray:
    """The sketch of 512 bits as eight numbers."""
    return folded(sketch(hashes), 64).view(np.int64)


def may_be_similar(bits_a: bytes, size_a: int, bits_b: bytes, size_b: int) -> bool:
    """Whether sets with these sketches and sizes can be similar: |a - b| + |b - a| <= (|a| + |b|) / 9, a similarity of 4 / 5."""
    a, b = np.frombuffer(bits_a, np.uint8), np.frombuffer(bits_b, np.uint8)
    least = min(len(a), len(b))
    apart = int(np.bitwise_count(folded(a, least) ^ folded(b, least)).sum(dtype=np.int64))
    return apart * (SIMILAR + OF) <= (size_a + size_b) * (OF - SIMILAR)


def prefix(hashes: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the order; common holds the common ones, in ascending order."""
    if len(common) and len(hashes):
        last = common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] == hashes
        hashes = np.append(hashes[~last], hashes[last])
    return hashes[: len(hashes) - (len(hashes) * SIMILAR + OF - 1) // OF + 1] if len(hashes) else hashes


def can_be(size_a, at_a, size_b, at_b):
    """Whether sets of these sizes, with a shingle in common at these places and none before, can be similar."""
    most = np.minimum(size_a - at_a, size_b - at_b)
    return most * (SIMILAR + OF) >= (size_a + size_b) * SIMILAR


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * OF >= (len(a) + len(b) - both) * SIMILAR


def _common(docs: DataFrame) -> np.ndarray:
    """The shingles that many texts of a sample have, in ascending order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t or "") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64))], ["key"])

    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0).select("text")
    counted = sized_batches(some).mapInArrow(run, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON)
    rows = counted.orderBy(F.desc("n"), "key").limit(MOST_COMMON).select("key").toArrow()
    return np.sort(rows.column(0).to_numpy().astype(np.int64).view(np.uint64))


def _nodes(docs: DataFrame) -> DataFrame:
    """(doc_id, hash, node, size, print, sketch, parities) of every row of docs."""

    @alone("near_copies")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t or "") for t in batch.column(1).to_pylist()]
            bits = np.array([parities(s) for s in sets], np.int64).reshape(-1, len(PARITIES))
            columns = [pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32())]
            prints = np.array([print_of(s) for s in sets], np.uint64).view(np.int64)
            columns += [pa.array(prints), pa.array([sketch(s).tobytes() for s in sets], pa.binary()), *map(pa.array, bits.T.copy())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], ["doc_id", "hash", "node", "size", "print", "sketch", *PARITIES])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
    return sized_batches(rows).mapInArrow(run, "doc_id long, hash long, node long, size int, print long, sketch binary" + "".join(f", {x} long" for x in PARITIES))


def _postings(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """(key, node, size, place): the prefix of every text."""

    @alone("near_copies")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies in the same task give nothing new
        for batch in batches:
            keys, nodes, sizes = [], [], []
            for text in batch.column(0).to_pylist():
                hashes = shingle_set(text or "")
                if (node := node_of(hashes)) not in seen:
                    seen.add(node)
                    keys.append(prefix(hashes, common))
                    nodes.append(node)
                    sizes.append(len(hashes))
            n = np.array([len(k) for k in keys], np.int64)
            key = np.concatenate([*keys, np.empty(0, np.uint64)]).view(np.int64)
            place = np.arange(len(key)) - np.repeat(np.cumsum(n) - n, n)
            columns = key, np.repeat(np.array(nodes, np.int64), n), np.repeat(np.array(sizes, np.int32), n), place.astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "node", "size", "place"])

    return sized_batches(docs.select("text")).mapInArrow(run, "key long, node long, size int, place int")


@alone("near_copies")
def _lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of keys that several nodes have, each once and with its key's lead; rows come sorted by key and node."""
    for columns, _ in whole_keys(batches):
        once = np.append(True, (np.diff(columns[0]) != 0) | (np.diff(columns[1]) != 0))
        key, node, size, place = (c[once] for c in columns)
        starts = np.append(0, np.flatnonzero(np.diff(key)) + 1)
        counts = np.diff(np.append(starts, len(key)))
        salt = (key[starts].view(np.uint64) >> np.uint64(7)) % np.uint64(LEADS) + np.uint64(1)
        rank = (node.view(np.uint64) ^ np.repeat(salt * _MIXER, counts)) * _MIXER
        order = np.lexsort((rank, key))
        first = np.repeat(order[starts], counts)
        shared = np.repeat(counts > 1, counts)
        columns = [c[shared] for c in (key, node, size, place, node[first], size[first], place[first])]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "node", "size", "place", "lead", "lead_size", "lead_place"])


def _met_across(batches: Iterator[pa.RecordBatch], nearest: bool) -> Iterator[pa.RecordBatch]:
    """Of each key the pairs of nodes that are in different components; nearest: of each node outside the key's largest component only
    the pairs with the nearest sketch, in that component and in all others."""
    for (key, node, size, place, part, *bits), starts in whole_keys(batches):
        bits = np.stack(bits, 1).view(np.uint64)
        for start, end in zip(starts, np.append(starts[1:], len(key))):
            names, which, counts = np.unique(part[start:end], return_inverse=True, return_counts=True)
            if len(names) < 2:
                continue
            largest = which == counts.argmax()
            pairs = []
            for i in np.flatnonzero(~largest):
                other = which != which[i]
                if not nearest:
                    other &= largest | (np.arange(end - start) > i)
                other &= can_be(size[start + i], place[start + i], size[start:end], place[start:end])
                other = start + np.flatnonzero(other)
                apart = np.bitwise_count(bits[other] ^ bits[start + i]).sum(1, dtype=np.int64)
                near = apart * (SIMILAR + OF) <= (size[other].astype(np.int64) + size[start + i]) * (OF - SIMILAR)
                other, apart = other[near], apart[near]
                if nearest and len(other) > 2:
                    inside = largest[other - start]
                    other = np.array([other[at][apart[at].argmin()] for at in (inside, ~inside) if at.any()])
                a, b = np.full(len(other), node[start + i]), node[other]
                pairs.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))
            a, b = np.concatenate(pairs, 1)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


@alone("near_copies")
def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _met_across(batches, nearest=False)


@alone("near_copies")
def _nearest_across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _met_across(batches, nearest=True)


@alone("near_copies")
def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        near = [may_be_similar(*x) for x in zip(*(batch.column(i).to_pylist() for i in range(2, 6)))]
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(near, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])


@alone("near_copies")
def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, texts_a, texts_b = batch.columns
        sets: dict[str, np.ndarray] = {t: shingle_set(t) for t in {*texts_a.to_pylist(), *texts_b.to_pylist()}}
        near = pa.array([similar(sets[x], sets[y]) for x, y in zip(texts_a.to_pylist(), texts_b.to_pylist())], pa.bool_())
        yield pa.RecordBatch.from_arrays([a.filter(near), b.filter(near)], ["a", "b"])


def _few(df: DataFrame) -> DataFrame:
    """durable(df), of rows that aren't wide, in as few partitions as they ask for."""
    kept = durable(df)
    return gathered(kept, kept.count())


def _verified(pairs: DataFrame, marked: DataFrame, docs: DataFrame) -> DataFrame:
    """Of the pairs(a, b) the similar ones. Texts that many pairs name are dealt to several tasks."""
    sketches = marked.groupBy("node").agg(F.first(F.struct("size", "sketch")).alias("of"))
    met = pairs.distinct()
    for side in ("a", "b"):
        met = met.join(sketches.select(F.col("node").alias(side), F.col("of.sketch").alias(f"sketch_{side}"), F.col("of.size").alias(f"size_{side}")), side)
    pairs = _few(sized_batches(met.select("a", "b", "sketch_a", "size_a", "sketch_b", "size_b")).mapInArrow(_possible, "a long, b long"))
    named = pairs.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.lit(True).alias("first")), F.struct(F.col("b").alias("node"), F.lit(False).alias("first")))))
    routes = named.groupBy("node").agg(F.ceil(F.greatest(F.count_if("first"), F.count_if(~F.col("first"))) / ROUTED).cast("int").alias("routes"))
    one = marked.groupBy("node").agg(earliest().alias("x")).join(routes, "node")
    one = _few(one.select("node", "routes", F.col("x.doc_id").alias("_id"), F.xxhash64("x.doc_id", "x.hash").alias("_key"), F.col("x.hash").alias("_hash")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    rows = sifted(rows.withColumn("key", F.xxhash64("doc_id", "hash")), "key", sieve(one, "_key")).where("_maybe")
    same = (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash"))
    texts = rows.join(one, same).dropDuplicates(["_key", "node"])  # rows may be alike in both
    texts = durable(texts.select("node", "routes", "text"))
    number = texts.select("node", "routes")
    dealt = texts.select("node", F.explode(F.sequence(F.lit(0), F.col("routes") - 1)).alias("route"), "text")

    for side, other in (("a", "b"), ("b", "a")):
        n = number.select(F.col("node").alias(side), F.col("routes").alias("n"))
        pairs = pairs.join(n, side).withColumn("route", F.pmod(F.xxhash64(other), F.col("n")).cast("int")).drop("n")
        pairs = pairs.join(dealt.withColumnsRenamed({"node": side, "text": f"text_{side}"}), [side, "route"]).drop("route")
    return sized_batches(pairs.select("a", "b", "text_a", "text_b")).mapInArrow(_verify, "a long, b long")


def _by_fingerprint(marked: DataFrame) -> DataFrame:
    """Pairs (a < b) of nodes that span what operator 9's fuzzy keys link: fingerprints of five-word shingles within three bits."""
    first = durable(marked.groupBy("print").agg(F.min("node").alias("first")))
    same = marked.select("node", "print").distinct().join(first, "print").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    of = lambda side: first.select(F.col("print").alias(side), F.col("first").alias(f"node_{side}"))
    linked = print_links(first).join(of("a"), "a").join(of("b"), "b")
    return same.union(linked.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")))


def _parts(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) of all nodes."""
    roots = below(links).withColumnRenamed("node", "_node")
    return nodes.join(roots, nodes["node"] == roots["_node"], "left").select("node", F.coalesce("root", "node").alias("root"))


def _merged(parts: DataFrame, more: DataFrame) -> DataFrame:
    """parts(node, root) after more links(a, b): only roots are linked anew."""
    of = lambda side: parts.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
    met = more.join(of("a"), "a").join(of("b"), "b").where("root_a <> root_b")
    up = below(met.select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct())  # few roots have many links
    up = up.select(F.col("node").alias("root"), F.col("root").alias("upper"))
    return _few(parts.join(up, "root", "left").select("node", F.coalesce("upper", "root").alias("root")))


def _apart(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """The rows(key, node, size, place) with their roots of parts(node, root), of the keys whose nodes are in several components: later
    rounds, in which components only grow, look at no other ones, and only these rows get their sketches."""
    met = rows.select("key", "node", "size", "place").join(parts, "node").repartition("key")
    of = Window.partitionBy("key")
    met = met.withColumns({"least": F.min("root").over(of), "most": F.max("root").over(of)}).where("least <> most")
    return met.select("key", "node", "size", "place", "root")


def components(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """(node, root) of every node of marked(doc_id, hash, node, size, print, sketch, parities)."""
    keyed = _postings(docs, _common(docs)).repartition("key").sortWithinPartitions("key", "node")
    groups = durable(keyed.mapInArrow(_lead, "key long, node long, size int, place int, lead long, lead_size int, lead_place int"))
    # most * 9 >= (|a| + |b|) * 4, as in can_be
    most = F.least(F.col("size") - F.col("place"), F.col("lead_size") - F.col("lead_place"))
    near = groups.where(F.col("node") != F.col("lead")).where(most * (SIMILAR + OF) >= (F.col("size") + F.col("lead_size")) * SIMILAR)
    near = near.select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b"))
    led = durable(_verified(near.union(_by_fingerprint(marked)), marked, docs))
    sketches = marked.groupBy("node").agg(F.first(F.struct(*PARITIES)).alias("of"))
    left = groups.select("key", "node", "size", "place")

    def drawn(left: DataFrame) -> DataFrame:
        met = left.join(sketches, "node").select("key", "node", "size", "place", "root", "of.*")
        return met.repartition("key").sortWithinPartitions("key")

    parts = _few(_parts(marked.select("node").distinct(), led))
    for _ in range(ROUNDS):
        left = _few(_apart(left, parts))
        more = durable(_verified(drawn(left).mapInArrow(_nearest_across, "a long, b long"), marked, docs))
        if not (rows := more.count()):
            break
        parts = _merged(parts, gathered(more, rows))
    else:
        left = _few(_apart(left, parts))
    return _merged(parts, _verified(drawn(left).mapInArrow(_across, "a long, b long"), marked, docs))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of docs(doc_id, text, ...) of each component, all columns kept, as simhash.one_of_each chooses it."""
    marked = durable(_nodes(docs))
    first = marked.groupBy("node").agg(earliest().alias("x"))
    return one_of_root(docs, marked, first.join(components(docs, marked), "node"))
