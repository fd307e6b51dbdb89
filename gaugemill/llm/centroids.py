"""Exact integer k-means with Drake's adaptive bounds.

Every vector carries its cluster, an upper bound of the distance to its centroid, lower bounds of the distances
to the few next nearest centroids, in that order, and one for all the rest. When centroids move, bounds move by as
much. A vector whose bounds still tell its nearest centroid is not compared with any. Bounds are in doubles
and give way by ``SLACK``; wherever they do not decide, distances are computed as integers, so results are exact.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, settle_table, table

#: Relative error that bounds allow for, in each step.
SLACK = 1e-9
#: Largest component whose squared distances and sums of 2^35 vectors fit in 64 bits.
LARGEST = 1 << 27
_VECTOR = "id long, ints binary"
_STATE = _VECTOR + ", cluster int, upper double, near binary, lower binary, rest double, asked int"


def integer_vectors(vectors: DataFrame, dims: int, scale: float = 1024.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``id`` and ``ints`` (floor(scale * component), little-endian 64-bit) of the vectors that have exactly ``dims``
    components, none of them null or not finite. Raises where a component does not fit the arithmetic."""

    def run(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            ints = np.floor(x * scale)
            if (np.abs(ints) > LARGEST).any():
                raise ValueError(f"a component times {scale:g} is over {LARGEST}")
            rows = ints.astype("<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], names=["id", "ints"])

    v = F.col(vec_col).cast("array<double>")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where((F.size("v") == dims) & F.forall("v", finite))
    return rows.mapInArrow(run, _VECTOR)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of paired rows, as integers."""
    d = x - c
    return np.einsum("...i,...i->...", d, d)


def scan(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances to all centroids, one column each."""
    return np.stack([squared(x, c) for c in centroids], axis=1)


def ordered(d2: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cluster, its distance, the ``keep`` next nearest centroids with their distances, and that of the nearest of the rest."""
    order = np.argsort(d2, axis=1, kind="stable")  # ties: the smaller number
    root = np.sqrt(np.take_along_axis(d2, order, 1).astype(float))
    rest = root[:, keep + 1] if d2.shape[1] > keep + 1 else np.full(len(d2), np.inf)
    return order[:, 0].astype(np.int32), root[:, 0] * (1 + SLACK), order[:, 1 : keep + 1].astype(np.int32), root[:, 1 : keep + 1] * (1 - SLACK), rest * (1 - SLACK)


class Bounds:
    """The state of a batch of vectors; ``move`` carries it from one set of centroids to the next."""

    def __init__(self, x: np.ndarray, centroids: np.ndarray, keep: int):
        self.x, self.asked = x, np.full(len(x), keep + 1, np.int32)
        self.cluster, self.upper, self.near, self.lower, self.rest = ordered(scan(x, centroids), keep)

    @classmethod
    def stored(cls, x, cluster, upper, near, lower, rest) -> Bounds:
        self = cls.__new__(cls)
        self.x, self.cluster, self.upper, self.near, self.lower, self.rest = x, cluster, upper, near, lower, rest
        self.asked = np.zeros(len(x), np.int32)
        return self

    def move(self, before: np.ndarray, centroids: np.ndarray, keep: int) -> None:
        """Keeps at most ``keep`` of the lower bounds; those dropped are folded into the bound of the rest."""
        shift = np.sqrt(squared(before, centroids).astype(float)) * (1 + SLACK)
        self.asked[:] = 0
        if self.lower.shape[1] > keep:
            self.rest = np.minimum(self.rest, self.lower[:, keep:].min(axis=1))
            self.near, self.lower = self.near[:, :keep], self.lower[:, :keep]
        width = self.lower.shape[1]
        self.upper = (self.upper + shift[self.cluster]) * (1 + SLACK)
        self.lower = (self.lower - shift[self.near]) * (1 - SLACK)
        self.rest = (self.rest - shift.max()) * (1 - SLACK)
        nearest = lambda i: np.minimum(self.lower[i].min(axis=1, initial=np.inf), self.rest[i])
        open_ = np.arange(len(self.x))
        open_ = open_[self.upper >= nearest(open_)]
        # First the own distance as it is, then the stored ones, then all.
        self.upper[open_] = np.sqrt(squared(self.x[open_], centroids[self.cluster[open_]]).astype(float)) * (1 + SLACK)
        open_ = open_[self.upper[open_] >= nearest(open_)]
        if width and len(open_):
            self.asked[open_] = width
            near = np.concatenate((self.cluster[open_, None], self.near[open_]), axis=1)
            near.sort(axis=1)  # ties: the smaller number
            d2 = squared(self.x[open_, None, :], centroids[near])
            c, u, n, low, _ = ordered(d2, width)
            sure = u < self.rest[open_]
            hit = open_[sure]
            pick = lambda at: np.take_along_axis(near[sure], at[sure], 1)
            self.cluster[hit], self.upper[hit] = pick(c[:, None])[:, 0], u[sure]
            self.near[hit], self.lower[hit] = pick(n), low[sure]
            open_ = open_[~sure]
        if len(open_):
            self.asked[open_] = width + 1
            self.cluster[open_], self.upper[open_], self.near[open_], self.lower[open_], self.rest[open_] = ordered(scan(self.x[open_], centroids), width)


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width).copy()


def _assigned(rows: DataFrame, before: np.ndarray | None, centroids: np.ndarray, width: int, keep: int) -> DataFrame:
    """The state of every vector for ``centroids``, from its state for ``before`` (with ``width`` lower bounds) or anew."""
    dims = centroids.shape[1]

    def run(batches):
        for batch in batches:
            x = _matrix(batch["ints"], "<i8", dims)
            if before is None:
                b = Bounds(x, centroids, keep)
            else:
                column = lambda c: batch[c].to_numpy(zero_copy_only=False).copy()  # noqa: B023, E731
                b = Bounds.stored(x, column("cluster"), column("upper"), _matrix(batch["near"], "<i4", width), _matrix(batch["lower"], "<f8", width), column("rest"))
                b.move(before, centroids, keep)
            packed = lambda m, kind: pa.array([r.tobytes() for r in m.astype(kind)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["ints"], pa.array(b.cluster), pa.array(b.upper), packed(b.near, "<i4"), packed(b.lower, "<f8"), pa.array(b.rest), pa.array(b.asked)], names=[c.split()[0] for c in _STATE.split(", ")]
            )

    return rows.mapInArrow(run, _STATE)


def _sums(state: DataFrame, k: int, dims: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Vectors of each cluster, their sum, and how many bounds 99 of 100 vectors needed at most. A task adds up
    its vectors; the driver gets one number for each component of each cluster."""

    def run(batches):
        count, total, asked = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), np.zeros(k + 2, np.int64)
        for batch in batches:
            c, x = batch["cluster"].to_numpy(), _matrix(batch["ints"], "<i8", dims)
            count += np.bincount(c, minlength=k)
            for i in np.unique(c):
                total[i] += x[c == i].sum(axis=0)
            asked += np.bincount(batch["asked"].to_numpy(), minlength=k + 2)
        value = np.concatenate((total.ravel(), count, asked))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(value))), pa.array(value)], names=["place", "value"])

    rows = state.select("cluster", "ints", "asked").mapInArrow(run, "place long, value long").groupBy("place").agg(F.sum("value").alias("value")).collect()
    value = np.zeros(k * dims + 2 * k + 2, np.int64)
    value[[r["place"] for r in rows]] = [r["value"] for r in rows]
    total, count, asked = np.split(value, (k * dims, k * dims + k))
    total = total.reshape(k, dims)
    few = int(np.searchsorted(np.cumsum(asked), 0.99 * asked.sum()))
    return count, total, few


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors with the smallest lower-case hex sha256 of ``<seed>:<id>``, in that order; fewer if there are fewer.
    A null id comes last, rows that repeat an id in the order of their bytes."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = vectors.select(name.alias("name"), "ints").orderBy(F.col("name").asc_nulls_last(), "ints").limit(k).collect()
    return np.array([np.frombuffer(r["ints"], "<i8") for r in rows], np.int64)


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: float = 1024.0, seed: int = 3, checkpoint_every: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """Lloyd's rounds over integer vectors: ``vec_id, cluster, distance`` (squared) of each vector, and the centroids.

    A round assigns every vector to its nearest centroid (ties: the smaller number), then each centroid with
    vectors becomes the floor of their mean by component; after the last round vectors are assigned once
    more. A round is one pass without a shuffle over the vectors and their bounds, which the next reads from Spark's cache
    (memory, then disk) and which are written to the shared folder every ``checkpoint_every`` rounds; what
    an executor takes with it is computed again from there. Only sums of clusters reach the driver. The number of
    lower bounds shrinks, from a quarter of ``k`` to an eighth at least, to what 99 of 100 vectors needed.

    Vectors that are null, of another length or with null or non-finite components are left out. Rows that
    repeat an id are separate vectors, equal vectors get equal results. With fewer than ``k`` vectors
    there are as many centroids; without any, no rows. Other columns are ignored, whatever their names.
    """
    rows = settle_table(integer_vectors(vectors, dims, scale, id_col, vec_col), "vectors")
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        return rows.select(F.col("id").alias("vec_id"), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    k = len(centroids)
    keep = width = min(k - 1, max(2, k // 4))
    before, state, held = None, rows, []
    for turn in range(rounds):
        state = _assigned(state, before, centroids, width, keep)
        width = keep
        state = settle(state) if (turn + 1) % checkpoint_every == 0 else state.persist()
        count, total, few = _sums(state, k, dims)
        keep = min(keep, max(1, k // 8, few))
        before, centroids = centroids, np.where(count[:, None] > 0, total // np.maximum(count, 1)[:, None], centroids)
        held.append(state)
        for old in held[:-1]:
            old.unpersist()
        held = held[-1:]
    out = settle(_distances(_assigned(state, before, centroids, width, keep), centroids))
    for old in held:
        old.unpersist()
    return out, centroids


def _distances(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    def run(batches):
        for batch in batches:
            c = batch["cluster"].to_numpy()
            yield pa.RecordBatch.from_arrays([batch["id"], batch["cluster"], pa.array(squared(_matrix(batch["ints"], "<i8", centroids.shape[1]), centroids[c]))], names=["vec_id", "cluster", "distance"])

    return state.mapInArrow(run, "vec_id long, cluster int, distance long")


def op13_centroids(spark, sf_dir):
    found, centroids = cluster(table(spark, sf_dir, "embeddings"))
    names = [(i, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    names = spark.createDataFrame(names, "cluster int, centroid_sha256 string")
    by_cluster = F.broadcast(found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")))  # one row a centroid
    whole = F.broadcast(found.agg(F.sum("distance").alias("inertia")))
    out = found.join(by_cluster, "cluster").join(F.broadcast(names), "cluster").join(whole)
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = 8, rounds: int = 10) -> str:
    nearest = lambda c: f"""SELECT vec_id, v, arg_min(n, d * {k} + n) AS cluster, min(d) AS distance FROM
      (SELECT vec_id, v, n, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v CROSS JOIN {c}) GROUP BY vec_id, v"""  # noqa: E731
    steps = []
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({nearest(f'c{r}')})")
        steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT n, coalesce(m, c) AS c FROM c{r} LEFT JOIN (SELECT cluster, list(f ORDER BY i) AS m FROM
          (SELECT cluster, i, CAST(floor(sum(x)::DOUBLE / count(*)) AS BIGINT) AS f FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY cluster, i) GROUP BY cluster) ON n = cluster)""")
    return f"""WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
      c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS n, v AS c FROM (SELECT * FROM v ORDER BY sha256('3:' || vec_id) LIMIT {k})),
      {", ".join(steps)}, z AS ({nearest(f"c{rounds}")})
      SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
        sha256(array_to_string(c, ',')) AS centroid_sha256 FROM z JOIN c{rounds} ON n = cluster"""


QUERIES = {"op13_centroids": op13_centroids}
SQL = {"op13_centroids": _sql()}
