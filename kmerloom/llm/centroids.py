"""Centroid clustering over dictionary-encoded dimension blocks, in exact integers.

Vectors are cut into blocks of ``width`` dimensions. A chunk of vectors keeps, for every block, the
distinct subvectors that occur in it (its dictionary) and one code per vector, which loses nothing.
A round computes the exact squared distance of each distinct subvector to the same block of every
centroid once, and a vector's distances are the sums of its codes' partial distances. Sums of a
cluster come from the counts of the codes in the same way. Chunks are encoded once and written; each
round reads the codes again. Only ``k`` centroids and their sums pass through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.plans.runtime import cut

#: Vectors that share dictionaries.
CHUNK = 4096
#: Components stay within this, so that squared distances of up to 64 dimensions fit a LONG.
LARGEST = 1 << 27

_CHUNKS = "vec_ids array<long>, codes binary, entries binary, sizes array<int>"


def quantised(vectors: DataFrame, dims: int = 64, scale: int = 64) -> DataFrame:
    """``vectors(vec_id, embedding)`` -> ``(vec_id, v)``: the whole vectors as integers floor(scale * x), x as double.

    Vectors that are null, have another number of components, or a null, NaN or infinite component go.
    A component beyond ``LARGEST`` fails the job, since its distances would not be exact.
    """
    infinite = F.lit(float("inf"))
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite))
    large = F.raise_error(F.lit(f"a component times {scale} lies beyond {LARGEST}"))

    def floor(x):
        y = F.floor(x.cast("double") * F.lit(float(scale)))
        return F.when(F.abs(y) <= LARGEST, y).otherwise(large.cast("long"))

    kept = vectors.select("vec_id", "embedding").where((F.size("embedding") == dims) & whole)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", floor).alias("v"))


def dictionary(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of a block (ascending) and each row's code."""
    key, count = np.zeros(len(part), dtype=np.int64), 1
    for column in part.T:
        # codes of the columns so far and of this one are below the number of rows, so their pairs fit
        values, code = np.unique(column, return_inverse=True)
        _, key = np.unique(key * len(values) + code, return_inverse=True)
        count = int(key.max(initial=-1)) + 1
    first = np.full(count, len(part), dtype=np.int64)
    np.minimum.at(first, key, np.arange(len(part)))
    return part[first], key


def _encode(batches: Iterator[pa.RecordBatch], dims: int, width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            ids, v = (batch.column(i).slice(at, CHUNK) for i in (0, 1))
            rows = v.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            codes, entries, sizes = np.empty((len(rows), -(-dims // width)), dtype="<u2"), [], []
            for b in range(codes.shape[1]):
                found, codes[:, b] = dictionary(rows[:, b * width : (b + 1) * width])
                entries.append(found.astype("<i4").tobytes())
                sizes.append(len(found))
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([codes.tobytes()]), pa.array([b"".join(entries)]), pa.array([sizes], pa.list_(pa.int32()))],
                ["vec_ids", "codes", "entries", "sizes"],
            )


def encoded(vectors: DataFrame, dims: int, width: int) -> DataFrame:
    """Chunks of ``quantised`` vectors: their ids, codes of all blocks, and the blocks' dictionaries one after the other."""
    return vectors.select("vec_id", "v").mapInArrow(lambda it: _encode(it, dims, width), _CHUNKS)


def _opened(batches: Iterator[pa.RecordBatch], dims: int, width: int) -> Iterator[tuple]:
    """(vec_ids, codes, dictionaries) of each chunk; a dictionary comes with the dimension it starts at."""
    for batch in batches:
        for i in range(batch.num_rows):
            ids, codes, entries, sizes = (batch.column(j)[i] for j in range(4))
            blocks, at = [], 0
            data = np.frombuffer(entries.as_buffer(), dtype="<i4")
            for b, size in enumerate(sizes.as_py()):
                wide = min(width, dims - b * width)
                blocks.append((b * width, data[at : at + size * wide].reshape(size, wide).astype(np.int64)))
                at += size * wide
            yield ids.values, np.frombuffer(codes.as_buffer(), dtype="<u2").reshape(-1, len(blocks)), blocks


def nearest(codes: np.ndarray, blocks: list, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (the smaller one of equals) and its squared distance, by sums of partial distances."""
    total = np.zeros((len(codes), len(centroids)), dtype=np.int64)
    for b, (low, entries) in enumerate(blocks):
        apart = entries[:, None, :] - centroids[None, :, low : low + entries.shape[1]]
        total += (apart * apart).sum(axis=2)[codes[:, b]]
    best = total.argmin(axis=1)
    return best, total[np.arange(len(codes)), best]


def _sums(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, dims: int, width: int) -> Iterator[pa.RecordBatch]:
    """Count and componentwise sum of each cluster's vectors in this task."""
    counts, sums = np.zeros(len(centroids), dtype=np.int64), np.zeros((len(centroids), dims), dtype=np.int64)
    for _, codes, blocks in _opened(batches, dims, width):
        best, _ = nearest(codes, blocks, centroids)
        counts += np.bincount(best, minlength=len(centroids))
        for b, (low, entries) in enumerate(blocks):
            often = np.bincount(best * len(entries) + codes[:, b], minlength=len(centroids) * len(entries))
            sums[:, low : low + entries.shape[1]] += often.reshape(len(centroids), -1) @ entries
    used = np.flatnonzero(counts)
    if len(used):
        cluster, dim = np.repeat(used, dims), np.tile(np.arange(dims), len(used))
        yield pa.RecordBatch.from_arrays([pa.array(cluster.astype(np.int32)), pa.array(dim.astype(np.int32)), pa.array(np.repeat(counts[used], dims)), pa.array(sums[used].ravel())], ["cluster", "dim", "n", "s"])


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, dims: int, width: int) -> Iterator[pa.RecordBatch]:
    for ids, codes, blocks in _opened(batches, dims, width):
        best, distance = nearest(codes, blocks, centroids)
        yield pa.RecordBatch.from_arrays([ids, pa.array(best.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])


def starts(vectors: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The k vectors whose ``seed:vec_id`` has the smallest sha256, in the order of the hashes."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [r["v"] for r in vectors.select(drawn.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()]


def clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: str = "1", dims: int = 64, scale: int = 64, width: int = 2) -> tuple[DataFrame, np.ndarray]:
    """``vectors(vec_id, embedding)`` -> ``(vec_id, cluster, distance)``, one row per whole vector, and the k centroids.

    What counts as whole is told by ``quantised``. Nearest means squared Euclidean distance, ties go to
    the smaller number. A round replaces every centroid that has vectors by the floor of their mean; the
    others stay. Repeated rows count as often as they occur; rows with a null vec_id take part but start a
    centroid only if there are too few others; of rows with one vec_id the smallest vector starts first. With
    fewer than k whole vectors there are as many centroids as vectors, with none no rows. Other columns are
    not looked at. Sums are exact for any number of rows.
    """
    whole = quantised(vectors, dims, scale)
    first = starts(whole, k, seed)
    centroids = np.array(first, dtype=np.int64).reshape(len(first), dims)
    chunks = cut(encoded(whole, dims, width))
    for _ in range(rounds if len(first) else 0):
        held = centroids
        sums = chunks.mapInArrow(lambda it, c=held: _sums(it, c, dims, width), "cluster int, dim int, n long, s long")
        sums = sums.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
        centroids = held.copy()
        for r in sums.collect():
            centroids[r["cluster"], r["dim"]] = int(r["s"]) // r["n"]
    if not len(first):
        return chunks.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    return chunks.mapInArrow(lambda it: _assigned(it, centroids, dims, width), "vec_id long, cluster int, distance long"), centroids


def query(vectors: DataFrame) -> DataFrame:
    spark = vectors.sparkSession
    found, centroids = clusters(vectors)
    found = cut(found)
    # one row per centroid
    inertia = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    told = [(c, inertia.get(c, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids.tolist())]
    facts = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = 16, rounds: int = 3) -> str:
    steps = [
        "kept AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings"
        " WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (SELECT sha256('1:' || vec_id) AS h, v FROM kept ORDER BY h LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"d{r} AS (SELECT vec_id, kept.v, c, list_sum(list_transform(list_zip(kept.v, c{r}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM kept CROSS JOIN c{r}),"
            f" a{r} AS (SELECT vec_id, v, c, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)"
        )
        if r < rounds:
            steps.append(
                f"s{r} AS (SELECT c, i, sum(v[i]) AS s, count(*) AS n FROM a{r} CROSS JOIN range(1, 65) AS t(i) GROUP BY c, i),"
                f" m{r} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM s{r} GROUP BY c),"
                f" c{r + 1} AS (SELECT c, coalesce(m{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN m{r} USING (c))"
            )
    return (
        "WITH " + ",\n".join(steps) + f"\nSELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,"
        f" CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (c)"
    )


SQL = _sql()
