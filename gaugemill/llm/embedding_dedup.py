"""Embedding near-dedup: PCA-ordered tiles with suffix-norm bounds, exact in double precision."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, table
from .components import components

SLACK = 1e-9


def _usable(docs: DataFrame, id_col: str, label_col: str, vec_col: str) -> DataFrame:
    """``id, label, dim, key, vec``: rows with a vector that can link; key identifies equal vectors."""

    def run(batches):
        for batch in batches:
            keep, dims, keys, vecs = [], [], [], []
            for i, v in enumerate(batch.column(2)):
                x = np.array(v.as_py(), float) if v.is_valid else np.zeros(0)
                if not len(x) or not np.isfinite(x).all() or not x.any():
                    continue
                x = x + 0.0  # -0 and 0 are one number
                keep.append(i)
                dims.append(len(x))
                vecs.append(x.astype("<f8").tobytes())
                keys.append(hashlib.blake2b(vecs[-1], digest_size=16).digest())
            at = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(dims, pa.int32()), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary())], names=["id", "label", "dim", "key", "vec"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("v")).where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    return rows.mapInArrow(run, "id long, label string, dim int, key binary, vec binary")


def _scaled(x: np.ndarray) -> np.ndarray:
    """The vectors, each times the power of two that brings its largest component near 1: their cosines stay the same to
    the bit, and squares of very small or large ones neither vanish nor overflow."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])


def _matrix(column, dim: int) -> np.ndarray:
    return _scaled(np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, dim))


def principal_axes(reps: DataFrame) -> dict[int, np.ndarray]:
    """For each dimension that occurs, the eigenvectors of the covariance of all unit vectors, by falling
    eigenvalue. One matrix of (dim + 1) x (dim + 1) per dimension reaches the driver: sums, and
    sums of products."""

    def part(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column(0).to_numpy(zero_copy_only=False)
            for d in np.unique(dims).tolist():
                x = _matrix(batch.column(1).filter(pa.array(dims == d)), d)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                x = np.concatenate((x, np.ones((len(x), 1))), axis=1)
                total[d] = total.get(d, 0) + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([m.tobytes() for m in total.values()], pa.binary())], names=["dim", "m"])

    def whole(key, t):
        d = key[0].as_py()
        return pa.table({"dim": pa.array([d], pa.int32()), "m": [sum(np.frombuffer(b, "<f8") for b in t["m"].to_pylist()).tobytes()]})

    rows = reps.select("dim", "vec").mapInArrow(part, "dim int, m binary").groupBy("dim").applyInArrow(whole, "dim int, m binary").collect()
    out = {}
    for r in rows:
        m = np.frombuffer(r.m, "<f8").reshape(r.dim + 1, r.dim + 1)
        mean = m[:-1, -1] / m[-1, -1]
        out[r.dim] = np.linalg.eigh(m[:-1, :-1] / m[-1, -1] - np.outer(mean, mean))[1][:, ::-1]
    return out


def linked(x: np.ndarray, y: np.ndarray, axes: np.ndarray, threshold: float, block: int = 16) -> np.ndarray:
    """Which rows of ``x`` and ``y`` have a cosine of ``threshold`` or more.

    Dimensions are taken in the order of ``axes``. After each block the rest of a product is at most
    the product of the two suffix norms; pairs that cannot reach the threshold stop there. What is
    left at the end is decided by the cosine of the original vectors.
    """
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    u, v = (x / nx[:, None]) @ axes, (y / ny[:, None]) @ axes
    su, sv = (np.sqrt(np.maximum(np.cumsum((a * a)[:, ::-1], axis=1)[:, ::-1], 0)) for a in (u, v))
    dim, at = x.shape[1], min(block, x.shape[1])
    rest = lambda s, k: s[:, k] if k < dim else np.zeros(len(s))
    dots = u[:, :at] @ v[:, :at].T
    i, j = np.nonzero(dots + np.outer(rest(su, at), rest(sv, at)) >= threshold - SLACK)
    partial = dots[i, j]
    while at < dim and len(i):
        to = min(dim, at + block)
        if len(i) * 4 > dots.size:  # most pairs live on: a product of whole tiles is cheaper
            partial = partial + (u[:, at:to] @ v[:, at:to].T)[i, j]
        else:
            partial = partial + np.concatenate([np.einsum("ij,ij->i", u[i[k : k + 65536], at:to], v[j[k : k + 65536], at:to]) for k in range(0, len(i), 65536)])
        live = partial + rest(su, to)[i] * rest(sv, to)[j] >= threshold - SLACK
        i, j, partial, at = i[live], j[live], partial[live], to
    out = np.zeros(dots.shape, bool)
    for k in range(0, len(i), 65536):
        a, b = i[k : k + 65536], j[k : k + 65536]
        out[a, b] = np.einsum("ij,ij->i", x[a], y[b]) / (nx[a] * ny[b]) >= threshold
    return out


def forest(link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and each column of a link matrix the smallest row it is connected with, or -1."""
    n, none = link.shape[0], link.shape[0]
    rows, cols = np.where(link.any(1), np.arange(n), none), np.full(link.shape[1], none)
    while True:
        cols_ = np.where(link, rows[:, None], none).min(0, initial=none)
        rows_ = np.minimum(rows, np.where(link, cols_[None, :], none).min(1, initial=none))
        if (rows_ == rows).all() and (cols_ == cols).all():
            return np.where(rows == none, -1, rows), np.where(cols == none, -1, cols)
        rows, cols = rows_, cols_


def near_dedup(spark: SparkSession, docs: DataFrame, threshold: float = 0.98, tile: int = 512, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """``id``, ``n_links``, ``component_id`` of every row of ``docs``.

    Equal vectors of a label are one representative with a weight. Representatives are sorted by
    label and first principal coordinate over range partitions and cut into tiles of at most ``tile``
    rows. Unit vectors with cosine >= t are at most sqrt(2 - 2t) apart, so only tiles of one label
    whose ranges of that coordinate come that close are compared; inside, leading dimensions decide
    most pairs. A pair of tiles returns link counts and a spanning forest, never its pairs.
    Rows with a null id or label, or a null, empty, zero or non-finite vector, link with nothing;
    vectors of different length never link. An empty table gives an empty result.
    """
    usable = settle(_usable(docs, id_col, label_col, vec_col))
    reps = settle(usable.groupBy("label", "dim", "key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight"), F.first("vec").alias("vec")))
    axes = principal_axes(reps)

    def first_coordinate(batches):
        for batch in batches:
            dims, vecs = batch.column(1).to_numpy(zero_copy_only=False), batch.column(5)
            y = np.zeros(len(dims))
            for d in np.unique(dims).tolist():
                x = _matrix(vecs.filter(pa.array(dims == d)), d)
                y[dims == d] = (x @ axes[d][:, 0]) / np.linalg.norm(x, axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(y)], names=[*batch.schema.names, "y"])

    def cut(batches):
        from pyspark import TaskContext

        base, n, held, size = TaskContext.get().partitionId() << 32, 0, [], 0
        names = ["tile", "label", "dim", "low", "high", "ids", "weights", "vecs"]

        def tiles(t: pa.Table, last: bool):
            nonlocal n
            label, dim = t["label"].to_numpy(), t["dim"].to_numpy()
            edges = [0, *(np.flatnonzero((label[1:] != label[:-1]) | (dim[1:] != dim[:-1])) + 1).tolist(), len(label)]
            rows = []
            for a, b in zip(edges, edges[1:], strict=False):
                for i in range(a, b, tile):
                    j = min(b, i + tile)
                    if not last and j == len(label):
                        return rows, t.slice(i)
                    y = t["y"][i:j].to_numpy()
                    rows.append((base + n, label[i], int(dim[i]), float(y.min()), float(y.max()), t["id"][i:j].to_numpy().astype("<i8").tobytes(), t["weight"][i:j].to_numpy().astype("<i8").tobytes(), b"".join(t["vec"][i:j].to_pylist())))
                    n += 1
            return rows, t.slice(t.num_rows)

        kinds = (pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary())
        record = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(len(names))], names=names)
        left = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            rows, left = tiles(t if left is None else pa.concat_tables([left, t]).combine_chunks(), False)
            if rows:
                yield record(rows)
        if left is not None and left.num_rows:
            yield record(tiles(left, True)[0])

    order = ["label", "dim", "y", "id"]
    placed = reps.select("label", "dim", "key", "id", "weight", "vec").mapInArrow(first_coordinate, "label string, dim int, key binary, id long, weight long, vec binary, y double")
    placed = placed.repartitionByRange(*order).sortWithinPartitions(*order).select("label", "dim", "y", "id", "weight", "vec")
    tiles = settle(placed.mapInArrow(cut, "tile long, label string, dim int, low double, high double, ids binary, weights binary, vecs binary"))
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + SLACK
    meta = tiles.select("tile", "label", "dim", "low", "high")
    pairs = meta.alias("a").join(meta.alias("b"), (F.col("a.label") == F.col("b.label")) & (F.col("a.dim") == F.col("b.dim")) & (F.col("a.tile") <= F.col("b.tile")) & (F.col("b.low") - F.col("a.high") <= reach) & (F.col("a.low") - F.col("b.high") <= reach))
    pairs = pairs.select(F.col("a.tile").alias("ta"), F.col("b.tile").alias("tb"), F.col("a.dim").alias("dim"))
    side = lambda s: tiles.select(F.col("tile").alias(f"t{s}"), F.col("ids").alias(f"ids_{s}"), F.col("weights").alias(f"weights_{s}"), F.col("vecs").alias(f"vecs_{s}"))
    work = pairs.join(side("a"), "ta").join(side("b"), "tb").select("ta", "tb", "dim", "ids_a", "weights_a", "vecs_a", "ids_b", "weights_b", "vecs_b")

    def compare(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids_a, w_a, ids_b, w_b = (np.frombuffer(r[c], "<i8") for c in ("ids_a", "weights_a", "ids_b", "weights_b"))
                x, y = (_scaled(np.frombuffer(r[c], "<f8").reshape(-1, r["dim"])) for c in ("vecs_a", "vecs_b"))
                link = linked(x, y, axes[r["dim"]], threshold)
                own = r["ta"] == r["tb"]
                if own:
                    np.fill_diagonal(link, False)
                if not link.any():
                    continue
                ids, counts = [ids_a], [link @ w_b]
                if own:  # rows and columns are the same vectors: a row is joined with its own column
                    np.fill_diagonal(link, link.any(1))
                rows, cols = forest(link)
                roots = [rows]
                if not own:
                    ids, counts, roots = ids + [ids_b], counts + [link.T @ w_a], roots + [cols]
                i, c, k = map(np.concatenate, (ids, counts, roots))
                hit = k >= 0
                yield pa.RecordBatch.from_arrays([pa.array(i[hit]), pa.array(c[hit].astype(np.int64)), pa.array(ids_a[k[hit]])], names=["id", "n", "root"])

    # Few rows carry much work: they are dealt one by one instead of by size.
    n_tasks = max(spark.sparkContext.defaultParallelism * 4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = settle(work.repartition(n_tasks, "ta", "tb").mapInArrow(compare, "id long, n long, root long"))
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    joined = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    per_rep = reps.select("label", "dim", "key", "id", "weight").join(counts, "id", "left").join(joined, "id", "left")
    per_rep = per_rep.select("label", "dim", "key", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    known = usable.select("id", "label", "dim", "key").join(per_rep, ["label", "dim", "key"]).select("id", "n_links", "component_id")
    # Rows that cannot link are read again as the complement, so every row of the table comes back once.
    lost = docs.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    bad = F.col("id").isNull() | F.col("label").isNull() | F.col("v").isNull() | (F.size("v") == 0) | F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) | F.forall("v", lambda e: e == 0.0)
    lost = lost.where(F.coalesce(bad, F.lit(True))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return known.unionByName(lost)


def op4_embedding_dedup(spark, sf_dir):
    out = near_dedup(spark, table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


OP4_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings WHERE label IS NOT NULL
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0
  WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98::DOUBLE
), r(x, y) AS (SELECT a, b FROM l UNION SELECT r.x, l.b FROM r JOIN l ON r.y = l.a),
c AS (SELECT x, min(y) AS m FROM r GROUP BY x), k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(k.n, 0) AS n_links, least(vec_id, coalesce(c.m, vec_id)) AS component_id, least(vec_id, coalesce(c.m, vec_id)) = vec_id AS kept
FROM embeddings e LEFT JOIN k ON k.a = e.vec_id LEFT JOIN c ON c.x = e.vec_id
"""

QUERIES = {"op4_embedding_dedup": op4_embedding_dedup}
SQL = {"op4_embedding_dedup": OP4_SQL}
