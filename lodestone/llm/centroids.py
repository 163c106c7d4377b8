"""Centroid clustering of integer vectors, on distinct vectors with multiplicities.

Vectors are quantised to integers and coded as bytes; equal codes are one row with a count. Lloyd's rounds run over
these rows: each task adds up its vectors times their counts, in integers, and a row a cluster and component is all that
leaves it. So a round is exact and has one result, however the rows are dealt. At the end, assignments are joined
back to the ids by the code.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.copies import join_groups
from lodestone.llm.shared import discard, materialize

DIM, SCALE, CLUSTERS, ROUNDS, SEED = 64, 1024, 8, 10, 3
NARROW, WIDE = np.dtype("<i2"), np.dtype("<i8")
LONG_MAX = (1 << 63) - 1
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def quantised(embeddings: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """``(vec_id, code)`` of ``embeddings(vec_id, embedding)``: floor(scale * x) of each component, 2 bytes each where they fit, else 8.

    Left out are vectors that are null, of another width, with a null or non-finite component, or with one whose
    integer is no long.
    """

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), dim), False))
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)  # nulls become NaN
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(x * scale)
                kept = (np.abs(x) < 2.0**63).all(axis=1)
            q = x[kept].astype(np.int64)
            small = (np.abs(q) < 1 << 15).all(axis=1)
            codes = [row.astype(NARROW if s else WIDE).tobytes() for row, s in zip(q, small, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(kept)), pa.array(codes, pa.binary())], ["vec_id", "code"])

    typed = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return typed.mapInArrow(code, "vec_id long, code binary")


def decoded(codes: list[bytes], dim: int) -> np.ndarray:
    return np.array([np.frombuffer(c, NARROW if len(c) == NARROW.itemsize * dim else WIDE) for c in codes], dtype=np.int64).reshape(-1, dim)


def nearest(q: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid, the smaller of equals, and the squared distance to it, both exact."""
    dim = q.shape[1]
    exact = math.isqrt((1 << 51) // dim)  # up to here all sums are integers that a double holds
    cluster, distance = np.zeros(len(q), np.int64), np.zeros(len(q), object)
    small = (np.abs(q) <= exact).all(axis=1) if all(abs(x) <= exact for c in centroids for x in c) else np.zeros(len(q), bool)
    x, c = q[small].astype(np.float64), np.array(centroids, np.float64)
    d = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)
    cluster[small] = d.argmin(axis=1)
    distance[small] = d.min(axis=1).astype(np.int64)
    for i in np.flatnonzero(~small):
        row = q[i].tolist()
        all_d = [sum((a - b) ** 2 for a, b in zip(row, c, strict=True)) for c in centroids]
        distance[i] = min(all_d)
        cluster[i] = all_d.index(distance[i])
    return cluster, distance


def _weighted(q: np.ndarray, n: np.ndarray) -> list[int]:
    """The exact sum of the rows of ``q``, each ``n`` times."""
    if float(np.abs(q).max(initial=0)) * float(n.sum()) < 2.0**62:
        return (q * n[:, None]).sum(axis=0).tolist()
    return (q.astype(object) * n.astype(object)[:, None]).sum(axis=0).tolist()


def _adder(centroids: list[list[int]], dim: int) -> Callable:
    """Per task: for each cluster the weighted sum of each component, and at place ``dim`` the number of vectors."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[int]] = {}
        for batch in batches:
            q, n = decoded(batch.column(0).to_pylist(), dim), batch.column(1).to_numpy()
            cluster, _ = nearest(q, centroids)
            for c in np.unique(cluster).tolist():
                mine = cluster == c
                more = [*_weighted(q[mine], n[mine]), int(n[mine].sum())]
                sums[c] = [a + b for a, b in zip(sums.get(c, [0] * (dim + 1)), more, strict=True)]
        rows = [(c, at, Decimal(total)) for c, each in sums.items() for at, total in enumerate(each)]
        if rows:
            clusters, places, totals = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(clusters, pa.int32()), pa.array(places, pa.int32()), pa.array(totals, pa.decimal128(38, 0))], ["cluster", "place", "total"])

    return add


def lloyd(distinct: DataFrame, centroids: list[list[int]], rounds: int = ROUNDS) -> list[list[int]]:
    """Centroids after ``rounds`` rounds over ``distinct(code, n)``: floor(sum / count) of each component, empty ones stay.

    A round that changes nothing is the last: those after it would not, either. A number a cluster and component comes to the driver.
    """
    dim = len(centroids[0])
    for _ in range(rounds):
        sums = distinct.select("code", "n").mapInArrow(_adder(centroids, dim), "cluster int, place int, total decimal(38,0)").groupBy("cluster", "place").agg(F.sum("total").alias("total"))
        found = {(r[0], r[1]): int(r[2]) for r in sums.collect()}
        moved = [[found[c, i] // found[c, dim] for i in range(dim)] if (c, dim) in found else old for c, old in enumerate(centroids)]
        if moved == centroids:
            break
        centroids = moved
    return centroids


def assigned(distinct: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``distinct(code, n)`` with cluster and distance, which is null where no long holds it."""
    dim = len(centroids[0])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance = nearest(decoded(batch.column(0).to_pylist(), dim), centroids)
            held = [int(d) if d <= LONG_MAX else None for d in distance]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster, pa.int32()), pa.array(held, pa.int64())], ["code", "n", "cluster", "distance"])

    return distinct.select("code", "n").mapInArrow(assign, "code binary, n long, cluster int, distance long")


def starts(vectors: DataFrame, clusters: int, dim: int, seed: int = SEED) -> list[list[int]]:
    """The vectors with the smallest hashes of seed and id, ``clusters`` of them or as many as there are; null ids come last."""
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.select(named.alias("named"), "code").orderBy(F.asc_nulls_last("named"), "code").limit(clusters)
    return decoded([bytes(r[1]) for r in first.collect()], dim).tolist()


def centroid_clusters(embeddings: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """Cluster ``embeddings(vec_id, embedding)`` and return one row for each vector that ``quantised`` keeps.

    Columns: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256. Null and repeated ids are vectors
    like others. With fewer vectors than ``clusters``, there are as many centroids as vectors; without any, no rows.
    Equal starts stay centroids of their own, of which the first gets the vectors. Sums of distances are null where no
    long holds them or one of the distances. Other columns are ignored.
    """
    spark = embeddings.sparkSession
    vectors = materialize(quantised(embeddings, dim, scale), "vector-codes")
    centroids = starts(vectors, clusters, dim, seed)
    if not centroids:
        return spark.createDataFrame([], RESULT)
    distinct = materialize(vectors.groupBy("code").agg(F.count("*").alias("n")), "distinct-vectors")
    final = lloyd(distinct, centroids, rounds)
    classes = materialize(assigned(distinct, final), "assigned-vectors")
    discard(distinct)
    exact = F.sum(F.col("distance").cast("decimal(38,0)") * F.col("n").cast("decimal(19,0)"))
    sums = {r[0]: (None if r[1] else int(r[2]), r[3]) for r in classes.groupBy("cluster").agg(F.count_if(F.col("distance").isNull()) > 0, exact, F.sum("n")).collect()}
    held = lambda total: total if total is not None and total <= LONG_MAX else None
    inertia = None if any(s is None for s, _ in sums.values()) else held(sum(s for s, _ in sums.values()))
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    about = spark.createDataFrame([(c, held(total), inertia, digest(final[c])) for c, (total, _) in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    joined = join_groups(vectors, classes, "code", "n", sum(n for _, n in sums.values()))
    return joined.join(F.broadcast(about), "cluster").select([c.split()[0] for c in RESULT.split(", ")])  # as many rows as clusters


def _oracle() -> str:
    """The rounds one after the other; every sum is an integer that a double holds."""
    d = "(list_inner_product(v.q::DOUBLE[], v.q::DOUBLE[]) - 2 * list_inner_product(v.q::DOUBLE[], c.q::DOUBLE[]) + list_inner_product(c.q::DOUBLE[], c.q::DOUBLE[]))::BIGINT"
    near = "a{0} AS MATERIALIZED (SELECT vec_id, any_value(v.q) AS q, min(" + d + " * 8 + c.c) AS m FROM v, c{0} c GROUP BY vec_id)"
    moved = """s{0} AS (SELECT m % 8 AS c, pos, sum(x)::HUGEINT AS s, count(*) AS n FROM (SELECT m, unnest(q) AS x, unnest(range(64)) AS pos FROM a{0}) GROUP BY ALL),
c{1} AS MATERIALIZED (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY pos) AS q FROM s{0} GROUP BY c UNION ALL SELECT c, q FROM c{0} WHERE c NOT IN (SELECT m % 8 FROM a{0}))"""
    rounds = ",\n".join(f"{near.format(k)},\n{moved.format(k, k + 1)}" for k in range(ROUNDS))
    return f"""WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, q FROM v ORDER BY c LIMIT 8),
{rounds},
{near.format(ROUNDS)}
SELECT vec_id, (m % 8)::INT AS cluster, m // 8 AS distance, (sum(m // 8) OVER (PARTITION BY m % 8))::BIGINT AS cluster_inertia, (sum(m // 8) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} c ON c.c = m % 8"""


ORACLE = _oracle()
