"""Centroid clustering with ball trees: whole balls go to a centroid where the triangle inequality allows it.

Vectors become whole numbers, so that sums, distances and floored means are exact. Each block of vectors gets a metric tree once,
kept as Parquet: its vectors in the order of the leaves, and for each ball its range of them, radius, count and sum. A round sends
the centroids to all tasks (k vectors) and walks down each tree: a centroid whose distance from a ball's middle is more than the
nearest one's by over twice the radius can't be the nearest of any vector in it; where one centroid is left, the ball's count and
sum are added to it, and leaves with several are settled vector by vector. Tasks give k sums each, which are added up by Spark.

Vectors of another length, null or with components that are null or not finite take no part. Equal vectors and ids are as many rows;
starts alike in id are told apart by their vectors. With fewer than k vectors each is a centroid; without any there are no rows.
Components over 131,072 are refused: their squared distances may not fit a long. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import stored

DIMS, SCALE, K, ROUNDS, SEED = 64, 1024, 8, 10, 3
#: Vectors of a tree at most, and of a leaf.
BLOCK, LEAF = 4096, 32
#: Largest whole number that a component may become.
LARGEST = 1 << 27
TREE = "ids array<long>, points array<long>, start array<int>, stop array<int>, child array<int>, radius array<double>, sums array<long>"


def lattice(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, point) of the vectors that take part, components floor(scale x)."""
    x = F.col("embedding").cast("array<double>")
    whole = (F.size(x) == dims) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))

    def number(v: Column) -> Column:
        return F.when(F.abs(v * scale) <= LARGEST, F.floor(v * scale)).otherwise(F.raise_error(F.lit("a component is too large for exact distances")))

    return vectors.where(whole).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, number).cast("array<long>").alias("point"))


def plant(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(order, balls): a ball holds order[start:stop]; child is the number of its first half's ball, the other half's is the
    next one, or -1 at a leaf. A ball is cut in two halves along the line through two points far from each other."""
    order, balls, todo = np.arange(len(points)), [(0, len(points))], [0]
    child, radius, sums = {}, {}, {}
    for at in todo:  # grows while it's walked through
        start, stop = balls[at]
        own = points[order[start:stop]]
        sums[at] = own.sum(0)
        away = np.sqrt(((own - sums[at] / len(own)) ** 2).sum(1))
        radius[at], child[at] = away.max(), -1
        if len(own) <= leaf or not radius[at]:
            continue
        one = own[away.argmax()]
        other = own[((own - one) ** 2).sum(1).argmax()]
        along = own @ (other - one)
        order[start:stop] = order[start:stop][np.argsort(along, kind="stable")]
        child[at], middle = len(balls), (start + stop) // 2
        todo += [len(balls), len(balls) + 1]
        balls += [(start, middle), (middle, stop)]
    n = range(len(balls))
    shape = lambda x, kind: np.array([x[i] for i in n], kind)
    return order, {"start": shape(balls, np.int64)[:, 0], "stop": shape(balls, np.int64)[:, 1], "child": shape(child, np.int64), "radius": shape(radius, float), "sums": shape(sums, np.int64)}


def trees(points: DataFrame, dims: int = DIMS) -> DataFrame:
    """A row for each block of (vec_id, point): the vectors in leaf order, and the balls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                own = np.asarray(batch.column(1).flatten()).reshape(-1, dims)
                order, balls = plant(own)
                lists = {"ids": batch.column(0).take(pa.array(order)), "points": pa.array(own[order].ravel())}
                lists |= {c: pa.array(balls[c], pa.int32()) for c in ("start", "stop", "child")} | {"radius": pa.array(balls["radius"]), "sums": pa.array(balls["sums"].ravel())}
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists.values()], list(lists))

    return points.mapInArrow(run, TREE)


def read_tree(row: dict[str, pa.Array], dims: int) -> dict[str, np.ndarray]:
    out = {k: np.asarray(x) for k, x in row.items() if k != "ids"}
    return out | {k: out[k].reshape(-1, dims) for k in ("points", "sums") if k in out}


def filtered(tree: dict[str, np.ndarray], centroids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(ball, centroids that may be the nearest of its vectors): balls with one of them, or leaves with several."""
    todo = [(0, np.arange(len(centroids)))]
    while todo:
        ball, may = todo.pop()
        middle = tree["sums"][ball] / (tree["stop"][ball] - tree["start"][ball])
        far = np.sqrt(((centroids[may] - middle) ** 2).sum(1))
        reach = far.min() + 2 * tree["radius"][ball]
        may = may[far <= reach + 1e-9 * (1 + reach + far.max())]  # more than what rounding can change
        if len(may) == 1 or tree["child"][ball] < 0:
            yield ball, may
        else:
            todo += [(tree["child"][ball], may), (tree["child"][ball] + 1, may)]


def nearest(points: np.ndarray, centroids: np.ndarray, may: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centroid, squared distance) of each point, exact; ties go to the smaller number."""
    squares = ((points[:, None, :] - centroids[may]) ** 2).sum(2)
    at = squares.argmin(1)
    return may[at], squares[np.arange(len(points)), at]


def totals(forest: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """(count, sum) of the vectors that are nearest to each centroid."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                tree = read_tree({c: batch.column(c)[i].values for c in batch.schema.names}, dims)
                for ball, may in filtered(tree, centroids):
                    start, stop = tree["start"][ball], tree["stop"][ball]
                    if len(may) == 1:
                        counts[may[0]] += stop - start
                        sums[may[0]] += tree["sums"][ball]
                    else:
                        cluster, _ = nearest(tree["points"][start:stop], centroids, may)
                        counts += np.bincount(cluster, minlength=k)
                        np.add.at(sums, cluster, tree["points"][start:stop])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(counts), pa.array(list(sums), pa.list_(pa.int64()))], ["cluster", "n", "sum"])

    each = forest.drop("ids").mapInArrow(run, "cluster long, n long, sum array<long>").where("n > 0")
    added = each.select("cluster", "n", F.posexplode("sum").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    out: dict[int, tuple[int, list[int]]] = {}
    for cluster, _, n, x in sorted(added.collect()):  # k times dims rows
        out.setdefault(cluster, (n, []))[1].append(x)
    return out


def moved(centroids: np.ndarray, added: dict[int, tuple[int, list[int]]]) -> np.ndarray:
    """The floored means; centroids without vectors stay."""
    return np.array([[x // added[c][0] for x in added[c][1]] if c in added else old for c, old in enumerate(centroids.tolist())], np.int64)


def assigned(forest: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].values for c in batch.schema.names}
                tree = read_tree(row, dims)
                cluster, distance = np.empty(len(row["ids"]), np.int64), np.empty(len(row["ids"]), np.int64)
                for ball, may in filtered(tree, centroids):
                    own = slice(tree["start"][ball], tree["stop"][ball])
                    cluster[own], distance[own] = nearest(tree["points"][own], centroids, may)
                yield pa.RecordBatch.from_arrays([row["ids"], pa.array(cluster), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return forest.mapInArrow(run, "vec_id long, cluster long, distance long")


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each of vectors(vec_id, embedding) that takes
    part, after so many rounds from the k vectors whose ids hash lowest."""
    points = lattice(vectors, dims, scale)
    forest = stored(trees(points, dims), "ball-trees")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    centroids = np.array([r["point"] for r in points.orderBy(digest, "point").limit(k).collect()], np.int64).reshape(-1, dims)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(centroids, totals(forest, centroids))
    found = assigned(forest, centroids)
    sums = [(c, d) for c, d in found.groupBy("cluster").agg(F.sum("distance")).collect()]  # k rows
    digests = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in centroids.tolist()]
    each = vectors.sparkSession.createDataFrame([(c, d, sum(x for _, x in sums), digests[c]) for c, d in sums], "cluster long, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(each), "cluster").select("vec_id", F.col("cluster").cast("int").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid_sha256")
