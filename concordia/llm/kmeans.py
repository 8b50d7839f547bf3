"""Centroid clustering by kd-tree filtering.

The kept vectors are turned into whole numbers once, dealt into blocks as they lie, and each block's kd-tree is written beside them: a node holds its box, its count and its sums. In each round
a node is shown the centroids that its parent left open. One that is farther than another from every point of the box is pruned; a node with one centroid left is assigned whole, from its
counts and sums; a leaf that is still open is resolved vector by vector. All of it is in whole numbers, so that sums agree however the work is split. Tasks send a round's counts and sums of
each cluster, no vectors.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, table

#: Vectors of a block and, at most, of a leaf whose vectors differ.
BLOCK, LEAF = 4096, 32
#: Components beyond this, once whole, would overflow the squared distance of a vector of 64.
LARGEST = 1 << 27


def tree_of(points: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(order, nodes) of a kd-tree over points: order puts each node's points one behind the other; nodes has start, end, left (-1 for a leaf; the right child is the next), low, high, total."""
    order, nodes, todo = np.arange(len(points)), [], [(0, len(points))]
    while len(nodes) < len(todo):  # breadth first; a node's children are put at the end together
        start, end = todo[len(nodes)]
        own = points[order[start:end]]
        low, high = own.min(0), own.max(0)
        left, wide = -1, high - low
        if end - start > LEAF and wide.max() > 0:
            axis, half = int(wide.argmax()), (end - start) // 2
            order[start:end] = order[start:end][np.argpartition(own[:, axis], half)]
            left = len(todo)
            todo += [(start, start + half), (start + half, end)]
        nodes.append((start, end, left, low, high, own.sum(0)))
    names = ("start", "end", "left", "low", "high", "total")
    return order, {n: np.array(x) for n, x in zip(names, zip(*nodes, strict=True), strict=True)}


def small(a: np.ndarray) -> np.ndarray:
    """The same numbers in the narrowest type that holds them."""
    for kind in (np.int16, np.int32):
        if not a.size or (a.min() >= np.iinfo(kind).min and a.max() <= np.iinfo(kind).max):
            return a.astype(kind)
    return a


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances [point, centroid] as int64, exact."""
    if max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0)) < 1 << 22:  # sums of products stay below 2^53
        p, c = points.astype(np.float64), centroids.astype(np.float64)
        return ((p * p).sum(1)[:, None] - 2 * (p @ c.T) + (c * c).sum(1)[None]).astype(np.int64)
    return np.stack([((points.astype(np.int64) - c) ** 2).sum(1) for c in centroids.astype(np.int64)], axis=1)


def open_centroids(low: np.ndarray, high: np.ndarray, centroids: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Those of `among` that may be a vector's nearest in the box from low to high: each that isn't farther, in the box's whole, than the one nearest to its middle.
    How much farther c is than best is linear over the box, and so least at the corner that lies from best towards c."""
    c = centroids[among]
    best = int(distances(low[None] + high[None], 2 * c)[0].argmin())
    corner = np.where(c > c[best], high, low)
    lead = ((corner - c) ** 2).sum(1) - ((corner - c[best]) ** 2).sum(1)
    return among[(lead <= 0)]


def filtered(points: np.ndarray, nodes: dict[str, np.ndarray], centroids: np.ndarray):
    """Yields (start, end, cluster, node): nodes that are assigned whole, with their number, and points of leaves, each with its own cluster and no node."""
    todo = [(0, np.arange(len(centroids)))]
    low, high = nodes["low"].astype(np.int64), nodes["high"].astype(np.int64)
    while todo:
        node, among = todo.pop()
        if len(among) > 1:
            among = open_centroids(low[node], high[node], centroids, among)
        start, end, left = int(nodes["start"][node]), int(nodes["end"][node]), int(nodes["left"][node])
        if len(among) == 1:
            yield start, end, int(among[0]), node
        elif left < 0:
            yield start, end, among[distances(points[start:end], centroids[among]).argmin(1)], None
        else:
            todo += [(left, among), (left + 1, among)]


def assigned(points: np.ndarray, nodes: dict[str, np.ndarray], centroids: np.ndarray) -> np.ndarray:
    out = np.zeros(len(points), np.int32)
    for start, end, cluster, _ in filtered(points, nodes, centroids):
        out[start:end] = cluster
    return out


def gathered(points: np.ndarray, nodes: dict[str, np.ndarray], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts, sums) by cluster."""
    counts, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
    for start, end, cluster, node in filtered(points, nodes, centroids):
        if node is not None:
            counts[cluster] += end - start
            sums[cluster] += nodes["total"][node]
        else:
            for c in np.unique(cluster):
                here = cluster == c
                counts[c] += here.sum()
                sums[c] += points[start:end][here].sum(0, dtype=np.int64)
    return counts, sums


def blocks(vectors: DataFrame, scratch: Scratch, *, id_col: str, vector_col: str, dim: int, scale: int) -> DataFrame:
    """(ids, points, nodes): the kept vectors as whole numbers, a block a row, with the block's kd-tree. What isn't kept is left out before Python sees it."""
    v = F.col("v")
    kept = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(
        (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    )
    kind = vectors.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        held, n = [], 0

        def block(rows):
            rows = pa.Table.from_batches(rows).combine_chunks()
            points = np.floor(rows.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim) * scale)
            if np.abs(points).max(initial=0) >= LARGEST:
                raise ValueError(f"components of {LARGEST // scale} or more: their squared distances don't fit a long")
            points = points.astype(np.int64)
            order, nodes = tree_of(points)
            ids = rows.column("id").combine_chunks().take(pa.array(order))
            packed = pickle.dumps({k: x if k == "total" else small(x) for k, x in nodes.items()}, protocol=5)
            lists = pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), ids)
            return pa.RecordBatch.from_arrays([lists, pa.array([pickle.dumps(small(points[order]), protocol=5)]), pa.array([packed])], names=["ids", "points", "nodes"])

        for batch in batches:
            while len(batch):
                part = batch.slice(0, BLOCK - n)
                held.append(part)
                n += len(part)
                batch = batch.slice(len(part))
                if n == BLOCK:
                    yield block(held)
                    held, n = [], 0
        if n:
            yield block(held)

    return kept, scratch.write(kept.mapInArrow(run, f"ids array<{kind}>, points binary, nodes binary"), "blocks")


def first_centroids(kept: DataFrame, k: int, scale: int, seed: str) -> np.ndarray:
    """The k kept vectors with the smallest sha256 of seed:id, equal ones by the vector."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = kept.select(key.alias("key"), F.transform("v", lambda x: F.floor(x * scale)).alias("v")).orderBy("key", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], dtype=np.int64)


def cluster(vectors: DataFrame, *, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: str = "3", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row a kept vector: id, cluster int, distance, cluster_inertia, inertia long, centroid_sha256.

    A vector is kept if it has dim components, none null, infinite or not a number; each becomes floor(scale * component). Null vectors and vectors of other lengths give no row. Centroids start
    as the k vectors with the smallest hashes of their ids (a null id hashes as an empty one), fewer if fewer are kept; rows that share an id or a vector are vectors by themselves, and equal
    centroids leave all to the first. Ties go to the smaller number, an empty cluster keeps its centroid. Ids of any type; other columns are ignored; an empty table gives no rows. Components of
    2^27 / scale or more are an error. The driver holds k centroids, nothing that grows with the vectors."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "kmeans")
    kept, trees = blocks(vectors, scratch, id_col=id_col, vector_col=vector_col, dim=dim, scale=scale)
    centroids = first_centroids(kept, k, scale, seed)
    kind = vectors.schema[id_col].dataType.simpleString()

    def gather(batches):
        import pyarrow as pa

        counts, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            for points, nodes in zip(batch.column(0), batch.column(1), strict=True):
                n, s = gathered(pickle.loads(points.as_buffer()), pickle.loads(nodes.as_buffer()), centroids)
                counts += n
                sums += s
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(counts), dtype=np.int32)), pa.array(counts), pa.array(list(sums), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    for _ in range(rounds if len(centroids) else 0):
        sent = trees.select("points", "nodes").mapInArrow(gather, "cluster int, n long, sums array<long>")
        by_dim = sent.select("cluster", "n", F.posexplode("sums").alias("dim", "s")).groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        for r in by_dim.where("n > 0").collect():  # k times dim numbers
            centroids[r["cluster"], r["dim"]] = r["s"] // r["n"]

    def assign(batches):
        import pyarrow as pa

        for batch in batches:
            for ids, points, nodes in zip(*batch.columns, strict=True):
                points = pickle.loads(points.as_buffer())
                own = assigned(points, pickle.loads(nodes.as_buffer()), centroids)
                far = np.zeros(len(own), np.int64)
                for c in np.unique(own):
                    far[own == c] = distances(points[own == c], centroids[c : c + 1])[:, 0]
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(own), pa.array(far)], names=["id", "cluster", "distance"])

    # written, so that sums and rows come from one pass over the trees
    found = scratch.write(trees.mapInArrow(assign, f"id {kind}, cluster int, distance long"), "assigned")
    inertia = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k numbers
    rows = [(i, inertia.get(i, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    of = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(of), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_kmeans(spark, sf_dir):
    return cluster(table(spark, sf_dir, "embeddings"))


def _op12_sql(k: int = 8, rounds: int = 10) -> str:
    near = """SELECT vec_id, v, c, d FROM (SELECT x.vec_id, x.v, z.c, list_sum(list_transform(range(1, 65), lambda i: (x.v[i] - z.v[i]) * (x.v[i] - z.v[i]))) AS d,
  row_number() OVER (PARTITION BY x.row ORDER BY d, z.c) AS n FROM x, {0} z) WHERE n = 1"""
    steps = []
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({near.format(f'z{r}')})")
        steps.append(f"""m{r} AS (SELECT c, list(CAST(CASE WHEN s < 0 THEN -((n - 1 - s) // n) ELSE s // n END AS BIGINT) ORDER BY i) AS v
  FROM (SELECT c, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, v, unnest(range(1, 65)) AS i FROM a{r}) GROUP BY c, i) GROUP BY c)""")
        steps.append(f"z{r + 1} AS MATERIALIZED (SELECT z.c, coalesce(m.v, z.v) AS v FROM z{r} z LEFT JOIN m{r} m USING (c))")
    return f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
x AS MATERIALIZED (SELECT vec_id, list_transform(e, lambda y: CAST(floor(1024 * y) AS BIGINT)) AS v, row_number() OVER () AS row FROM e
  WHERE len(e) = 64 AND len(list_filter(e, lambda y: y IS NOT NULL AND isfinite(y))) = 64),
z0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS INTEGER) AS c, v FROM x
  ORDER BY sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')), v LIMIT {k}),
{", ".join(steps)},
f AS MATERIALIZED ({near.format(f'z{rounds}')})
SELECT vec_id, f.c AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY f.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(z.v, ',')) AS centroid_sha256 FROM f JOIN z{rounds} z ON f.c = z.c"""


OP12_SQL = _op12_sql()
