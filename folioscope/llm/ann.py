"""Approximate nearest neighbours by a forest of random-projection trees.

Largest inner products are nearest neighbours once every vector gets one more component that brings all to the same length
(queries get zero there). Each tree splits space by hyperplanes across the direction of two random members of a node, at
the median; it's fitted on a bounded sample of the distinct vectors (SAMPLE), and every vector is then filed in its leaf
of each tree. A query descends all trees through one shared priority queue: the leaf on the right side of all its splits
first, then those that lie the least far across the margins on their path, of whichever tree, until it has seen a SHARE of
all leaves. Queries and vectors meet by leaf; there all inner products are computed, in double precision, and of each query the best K + 1 go on that score
no less than the (K + 1)th best of the sample. So what a leaf emits is bounded, and so is what comes together for a query.

Copies: rows of equal vectors are one vector in the forest, with the K + 1 smallest of their ids, which are all that can be
among K results of any query (its own id apart); each distinct query vector is searched once. Repeated rows of one id and
vector count once. Vectors null, empty, zero, or holding null or non-finite components take no part, nor do vectors of another
length than the commonest (of equally common lengths, the longer). Null ids take no part. Fewer rows give fewer results;
an empty table gives none.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import durable, sized_batches

K, EVERY = 20, 20
#: Trees; vectors that the trees are fitted on at most; of these, vectors of a leaf at least.
TREES, SAMPLE, SAMPLE_LEAF, SEED = 6, 32_768, 16, 42
#: Components of the sample's vectors at most, which bounds the sample of long vectors further.
SAMPLE_VALUES = SAMPLE * 64
#: The share of all leaves that a query looks into, and how many at least. Directions spread evenly over 64 dimensions, the
#: hardest case, need this share for a recall of 0.9; clustered vectors need far less.
SHARE, LEAST_PROBES = 0.15, 64
#: Vectors of a leaf wanted, where the sample allows it.
LEAF = 1024


@dataclass
class Forest:
    """Complete binary trees of the same height: node i of a tree has children 2 i + 1 and 2 i + 2."""

    normals: np.ndarray  # trees x inner nodes x dimensions
    offsets: np.ndarray  # trees x inner nodes
    longest: float  # the length that all vectors are brought to

    @property
    def height(self) -> int:
        return int(np.log2(self.normals.shape[1] + 1))

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(0.0, self.longest**2 - (x * x).sum(1)))])

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree (vectors x trees)."""
        x, out = self.lifted(vectors), []
        for normals, offsets in zip(self.normals, self.offsets):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.height):
                node = 2 * node + 1 + ((x * normals[node]).sum(1) > offsets[node])
            out.append(node - len(offsets))
        return np.stack(out, 1)

    def probe(self, queries: np.ndarray, probes: int) -> list[list[tuple[int, int]]]:
        """(tree, leaf) of the leaves that each query looks into, best first: one queue for all trees."""
        x = np.column_stack([queries, np.zeros(len(queries))])
        out, inner = [], self.normals.shape[1]
        margins = np.stack([x @ n.T - o for n, o in zip(self.normals, self.offsets)], 1) if inner else None
        for i in range(len(x)):
            queue = [(0.0, t, 0) for t in range(len(self.normals))]
            found: list[tuple[int, int]] = []
            while queue and len(found) < probes:
                far, tree, node = heapq.heappop(queue)
                if node >= inner:
                    found.append((tree, node - inner))
                    continue
                m = float(margins[i, tree, node])
                heapq.heappush(queue, (far + max(0.0, m) ** 2, tree, 2 * node + 1))
                heapq.heappush(queue, (far + max(0.0, -m) ** 2, tree, 2 * node + 2))
            out.append(found)
        return out


def grow(sample: np.ndarray, n_vectors: int, longest: float, trees: int = TREES, seed: int = SEED) -> Forest:
    """Trees as high as leaves of about LEAF of n_vectors need, or as SAMPLE_LEAF allows."""
    height = 0
    while n_vectors / 2 ** (height + 1) >= LEAF / 2 and len(sample) / 2 ** (height + 1) >= SAMPLE_LEAF:
        height += 1
    rng, inner = np.random.default_rng(seed), 2**height - 1
    forest = Forest(np.zeros((trees, inner, sample.shape[1] + 1)), np.zeros((trees, inner)), longest)
    x = forest.lifted(sample)
    for t in range(trees):
        members = {0: np.arange(len(x))}
        for node in range(inner):
            own = members.pop(node)
            for _ in range(8):
                a, b = (x[own[rng.integers(len(own))]] for _ in range(2)) if len(own) else (x[0], x[0])
                if (direction := a - b).any():
                    break
            else:
                direction = rng.standard_normal(x.shape[1])
            direction = direction / np.linalg.norm(direction)
            along = x[own] @ direction
            cut = float(np.median(along)) if len(own) else 0.0
            forest.normals[t, node], forest.offsets[t, node] = direction, cut
            members[2 * node + 1], members[2 * node + 2] = own[along <= cut], own[along > cut]
    return forest


def _vectors(column: pa.Array, kind: str = "<f8") -> np.ndarray:
    """Vectors of a list or (packed) binary column, in double precision."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        rows = column.to_pylist()
        return np.frombuffer(b"".join(rows), kind).astype(np.float64).reshape(len(rows), -1) if rows else np.empty((0, 0))
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _packed(vectors: np.ndarray, kind: str) -> pa.Array:
    return pa.array([v.tobytes() for v in vectors.astype(kind)], pa.binary())


def usable(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, vector) of the rows that take part."""
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).where("id is not null and vector is not null and size(vector) > 0")
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.where(finite & F.exists("vector", lambda v: v != 0))
    sizes = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return rows.where(F.size("vector") == (sizes[0]["n"] if sizes else 0))


def search(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, every: int = EVERY, share: float = SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found of each row whose id is divisible by `every`."""
    spark = table.sparkSession
    rows = usable(table, id_col, vector_col)
    hashed = rows.select("id", "vector", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2")).withColumn("asks", F.col("id") % every == 0)
    hashed = durable(hashed)
    # the least ids of a vector are limited before the shuffle; its number of rows may be anything
    first = hashed.withColumn("r", F.dense_rank().over(Window.partitionBy("h1", "h2").orderBy("id"))).where(F.col("r") <= k + 1)
    asked = hashed.where("asks").groupBy("h1", "h2").agg(F.first("vector").alias("vector"))
    distinct = first.groupBy("h1", "h2").agg(F.first("vector").alias("vector"), F.sort_array(F.collect_set("id")).alias("ids"))
    distinct = durable(distinct)
    norm = F.aggregate("vector", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    total = distinct.agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.max(norm)).alias("longest"), F.max(F.size("vector")).alias("dims")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not total["n"]:
        return spark.createDataFrame([], schema)
    kind = "<f4" if rows.schema["vector"].dataType.elementType.simpleString() == "float" else "<f8"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([_packed(_vectors(batch.column(0)), kind)], ["x"])

    size = max(1, min(SAMPLE, SAMPLE_VALUES // total["dims"]))
    sample = distinct.orderBy(F.xxhash64("h1", F.lit(SEED)), "h2").limit(size).select(F.col("vector").cast("array<double>").alias("vector"))
    drawn = np.frombuffer(b"".join(bytes(r["x"]) for r in sample.mapInArrow(pack, "x binary").collect()), kind).astype(np.float64).reshape(-1, total["dims"])
    forest = grow(drawn, total["n"], float(total["longest"]))
    probes = max(LEAST_PROBES, int(np.ceil(share * TREES * 2**forest.height)))
    shared = spark.sparkContext.broadcast((forest, drawn))  # SAMPLE_VALUES and TREES bound its size

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _vectors(batch.column(2))
                leaves, packed = shared.value[0].leaves(x), _packed(x, kind)
                for t in range(leaves.shape[1]):
                    yield pa.RecordBatch.from_arrays([pa.array(leaves[:, t] * TREES + t), batch.column(0), batch.column(1), packed, batch.column(3)], ["leaf", "h1", "h2", "vector", "first"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                x = _vectors(part.column(2))
                found = own.probe(x, probes)
                # no result of a query scores less than the (k + 1)th best of the sample, which all vectors include
                slack = 1e-9 * np.linalg.norm(x, axis=1) * own.longest  # far over what another order of adding up can change
                least = -np.partition(-(x @ seen.T), k, axis=1)[:, k] - slack if len(seen) > k else np.full(len(x), -np.inf)
                at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
                leaf = pa.array([leaf * TREES + tree for f in found for tree, leaf in f], pa.int64())
                yield pa.RecordBatch.from_arrays([leaf, *(c.take(at) for c in (part.column(0), part.column(1), _packed(x, kind), pa.array(least)))], ["leaf", "h1", "h2", "vector", "least"])

    def meet(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[] for _ in range(6)]
        if vectors.num_rows and queries.num_rows:
            x, asked_ = (_vectors(t["vector"].combine_chunks(), kind) for t in (vectors, queries))
            first, least = vectors["first"].to_numpy(), queries["least"].to_numpy()
            names = [queries["h1"].to_numpy(), queries["h2"].to_numpy(), vectors["h1"].to_numpy(), vectors["h2"].to_numpy()]
            for start in range(0, len(asked_), 256):
                q, v = np.nonzero(asked_[start : start + 256] @ x.T >= least[start : start + 256, None])
                exact = (asked_[start + q] * x[v]).sum(1)  # the same number for a pair wherever it meets
                order = np.lexsort((first[v], -exact, q))
                q, v, exact = q[order], v[order], exact[order]
                place = np.arange(len(q)) - np.searchsorted(q, q)
                q, v, exact = (a[place <= k] for a in (q, v, exact))
                for to, a in zip(out, (names[0][start + q], names[1][start + q], names[2][v], names[3][v], first[v], exact)):
                    to.append(a)
        kinds = [np.int64] * 5 + [np.float64]
        return pa.table({c: np.concatenate(a) if a else np.empty(0, t) for c, a, t in zip(("q1", "q2", "v1", "v2", "first", "score"), out, kinds)})

    wide = lambda d, *more: sized_batches(d.select("h1", "h2", F.col("vector").cast("array<double>").alias("vector"), *more))
    filed = wide(distinct, F.col("ids")[0].alias("first")).mapInArrow(file, "leaf long, h1 long, h2 long, vector binary, first long")
    probed = wide(asked).mapInArrow(ask, "leaf long, h1 long, h2 long, vector binary, least double")
    near = filed.groupBy("leaf").cogroup(probed.groupBy("leaf")).applyInArrow(meet, "q1 long, q2 long, v1 long, v2 long, first long, score double")
    # of a query, a leaf gives k + 1 rows at most, so what meets here is bounded; every vector has one id at least
    best = near.groupBy("q1", "q2").agg(F.slice(F.sort_array(F.collect_set(F.struct((-F.col("score")).alias("away"), "first", "v1", "v2"))), 1, k + 1).alias("best"))
    pairs = best.select("q1", "q2", F.explode("best").alias("x")).select("q1", "q2", "x.away", "x.v1", "x.v2")
    pairs = pairs.join(distinct.select(F.col("h1").alias("v1"), F.col("h2").alias("v2"), "ids"), ["v1", "v2"])
    found = F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct(F.col("away").alias("away"), i.alias("id")))))
    merged = pairs.groupBy("q1", "q2").agg(F.slice(F.sort_array(found), 1, k + 1).alias("best"))
    answers = hashed.where("asks").select(F.col("id").alias("query_id"), F.col("h1").alias("q1"), F.col("h2").alias("q2")).distinct().join(merged, ["q1", "q2"])
    own_out = F.slice(F.filter("best", lambda x: x["id"] != F.col("query_id")), 1, k)
    return answers.select("query_id", F.posexplode(own_out).alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.away")).alias("score"))
