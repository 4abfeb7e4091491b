"""Centroid clustering by delta Lloyd rounds, exact in integers.

Vectors are written once, as integers, to a table in the shared folder whose files are the units of work. Beside each
file lies, for every round, a small file of its vectors' owners and distances; the sums of all clusters are kept by the
driver (one row a cluster). A round goes through the files:

* a vector whose owner's centroid stayed is compared with the centroids that changed, and with no other, for all the rest are as
  far as before and its owner was the least of them by (distance, number);
* a vector whose owner moved is compared with all;
* a vector that changes its owner is a transfer: taken from one cluster's sum and added to another's. Each task sums its
  transfers by cluster and only these signed sums are shuffled.

A task that runs again reads the round before and writes the same file, so the loss of an executor costs its tasks only.
No vector moves between tasks, so a vector that fills a third of the table burdens none more than others.

Products of integers are exact in doubles while they stay below 2**53, which `_exact` decides from the largest
components; beyond, the same steps run on Python's integers (and compare with all centroids).

Vectors that are null, have another number of components or hold a null, infinite or undefined component are left out. Of
repeated rows each counts; a null id is a value like others and comes after all ids where vectors are chosen to begin with, in
which vectors with the same id are in order of their components. With fewer vectors than clusters all of them begin; an
empty table gives an empty result. Components of 2**100 and more are an error. Distances and their sums that a long cannot
hold are its largest value.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import storage

DIMENSIONS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
#: Vectors compared at once.
HELD = 1 << 14
_LONG = 2**63 - 1
_MOST = 2.0**100
_SUMS = "cluster int, n long, sums array<decimal(38,0)>, inertia decimal(38,0)"


def usable(vectors: DataFrame, dimensions: int) -> DataFrame:
    """(vec_id, embedding as doubles) of the vectors that count."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where((F.size("embedding") == dimensions) & F.coalesce(finite, F.lit(False)))


def _rows(column: pa.Array, dimensions: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dimensions)


def _integers(scaled: np.ndarray) -> np.ndarray:
    """Whole doubles as Python's integers."""
    return np.array([int(x) for x in scaled.ravel().tolist()], object).reshape(scaled.shape)


def _exact(x: np.ndarray, centroids: list[list[int]]) -> bool:
    """Whether all sums of squared differences are whole doubles."""
    most = max(float(np.abs(x).max(initial=0)), float(max((abs(v) for c in centroids for v in c), default=0)))
    return 4 * most * most * x.shape[1] < 2.0**53


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared, of every row of x with every centroid; whole doubles below 2**53, or Python's integers."""
    if x.dtype == object:
        return np.stack([((x - c) ** 2).sum(1) for c in centroids], 1)
    return (x * x).sum(1)[:, None] - 2 * (x @ centroids.T) + (centroids * centroids).sum(1)


def _compared(x: np.ndarray, owners: np.ndarray, distances: np.ndarray, centroids: list[list[int]], changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New owners and distances; x: whole doubles; changed: the numbers of the centroids that are not as in the round before."""
    if not _exact(x, centroids):
        own = _distances(_integers(x), np.array(centroids, object).reshape(len(centroids), -1))
        best = np.array([min(range(len(d)), key=d.__getitem__) for d in own.tolist()], np.int32)
        return best, own[np.arange(len(x)), best]
    table = np.array(centroids, np.float64)
    moved = np.isin(owners, changed) | (owners < 0)
    owners, distances = owners.copy(), np.asarray(distances, np.float64).copy()
    if moved.any():
        near = _distances(x[moved], table)
        best = near.argmin(1)  # the first of equals
        owners[moved], distances[moved] = best, near[np.arange(len(best)), best]
    stay = np.flatnonzero(~moved)
    if len(stay) and len(changed):
        near = _distances(x[stay], table[changed])
        at = near.argmin(1)
        least, number = near[np.arange(len(at)), at], changed[at]
        nearer = (least < distances[stay]) | ((least == distances[stay]) & (number < owners[stay]))
        owners[stay[nearer]], distances[stay[nearer]] = number[nearer], least[nearer]
    return owners, distances


def _transfers(x: np.ndarray, before: np.ndarray, after: np.ndarray, sums: dict[int, list]) -> None:
    """Adds to sums (cluster: [number, components]) what moves from owners to owners."""
    for owners, sign in ((before, -1), (after, 1)):
        some = np.flatnonzero((before != after) & (owners >= 0))
        for cluster in np.unique(owners[some]).tolist():
            rows = x[some[owners[some] == cluster]]
            exact = float(np.abs(rows).max(initial=0)) * len(rows) < 2.0**53
            total = rows.sum(0).tolist() if exact else _integers(rows).sum(0).tolist()
            held = sums.setdefault(cluster, [0, [0] * x.shape[1], 0])
            held[0] += sign * len(rows)
            held[1] = [a + sign * int(b) for a, b in zip(held[1], total, strict=True)]


def _total(distances: np.ndarray) -> int:
    exact = distances.dtype != object and float(distances.max(initial=0)) * len(distances) < 2.0**53
    return int(distances.sum()) if exact else sum(map(int, distances.tolist()))


def _state(owners: np.ndarray, distances: np.ndarray) -> bytes:
    out = io.BytesIO()
    held = np.minimum(distances, _LONG).astype(np.int64) if distances.dtype == object else distances
    np.savez_compressed(out, owners=owners.astype(np.int32), distances=held)
    return out.getvalue()


def _load(uri: str) -> tuple[np.ndarray, np.ndarray]:
    with np.load(io.BytesIO(storage.get_file(uri))) as found:
        return found["owners"], found["distances"]


class Clustering:
    """Vectors in the shared folder, and rounds over them."""

    def __init__(self, vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> None:
        self.spark: SparkSession = vectors.sparkSession
        self.dimensions, self.uri = dimensions, storage.new_dir(self.spark, "centroids")

        def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.floor(_rows(batch.column("embedding"), dimensions) * scale)
                if (np.abs(x) >= _MOST).any():
                    raise ValueError("a component is too large to be summed")
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * dimensions, x.ravel())], names=["vec_id", "x"])

        whole = usable(vectors, dimensions).mapInArrow(scaled, "vec_id long, x array<double>")
        whole.write.option("compression", "zstd").parquet(f"{self.uri}/vectors")
        self.files = [name for name, _ in storage.list_files(f"{self.uri}/vectors", ".parquet")]
        self.state = ""
        self.centroids: list[list[int]] = []
        self.totals: dict[int, tuple[int, list[int]]] = {}

    def begin(self, clusters: int = CLUSTERS, seed: int = SEED) -> None:
        """Centroids are the vectors with the least hashes of the id."""
        rows = self.spark.read.schema("vec_id long, x array<double>").parquet(f"{self.uri}/vectors")
        order = [F.col("vec_id").isNull(), F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256), F.col("x")]
        self.centroids = [[int(v) for v in r.x] for r in rows.orderBy(*order).limit(clusters).collect()]  # as many rows as clusters
        self.changed = list(range(len(self.centroids)))
        self.totals = {c: (0, [0] * self.dimensions) for c in self.changed}

    def _tasks(self) -> DataFrame:
        return self.spark.createDataFrame(list(enumerate(self.files)), "number int, uri string").repartitionById(len(self.files), "number")

    def assign(self) -> dict[int, int]:
        """One pass: every vector to its nearest centroid; sums follow the transfers. The sum of distances by cluster."""
        before_uri, uri = self.state, storage.new_dir(self.spark, f"{self.uri.rsplit('/', 1)[1]}/round")
        dimensions, centroids, changed = self.dimensions, self.centroids, np.array(self.changed, np.int32)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for number, name in zip(batch.column("number").to_pylist(), batch.column("uri").to_pylist(), strict=True):
                    before = _load(f"{before_uri}/{number}") if before_uri else None
                    owners, distances, sums, row = [], [], {}, 0
                    for x, _ in _vectors(name, dimensions):
                        held = [b[row : row + len(x)] for b in before] if before else [np.full(len(x), -1, np.int32), np.zeros(len(x))]
                        after = _compared(x, *held, centroids, changed)
                        _transfers(x, held[0], after[0], sums)
                        for cluster in np.unique(after[0]).tolist():
                            sums.setdefault(cluster, [0, [0] * dimensions, 0])[2] += _total(after[1][after[0] == cluster])
                        owners.append(after[0])
                        distances.append(after[1])
                        row += len(x)
                    storage.put_file(f"{uri}/{number}", _state(*(np.concatenate(c) if c else np.zeros(0) for c in (owners, distances))))
                    columns = [pa.array(c, k) for c, k in zip(zip(*((c, n, s, min(i, 2 * _LONG)) for c, (n, s, i) in sorted(sums.items())), strict=True) if sums else [[]] * 4, (pa.int32(), pa.int64(), pa.list_(pa.decimal128(38)), pa.decimal128(38)), strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names=["cluster", "n", "sums", "inertia"])

        sums = self._tasks().mapInArrow(scan, _SUMS) if self.files else self.spark.createDataFrame([], _SUMS)
        total = sums.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("inertia").alias("inertia"), *(F.sum(F.get("sums", F.lit(i))).alias(f"x{i}") for i in range(dimensions)))
        inertia = {}
        for r in total.collect():  # a row a cluster
            n, held = self.totals[r.cluster]
            self.totals[r.cluster] = n + r.n, [a + int(r[f"x{i}"]) for i, a in enumerate(held)]
            inertia[r.cluster] = int(r.inertia)
        if before_uri:
            storage.remove(before_uri)
        self.state = uri
        return inertia

    def move(self) -> None:
        """Every centroid with vectors to the floor of their mean."""
        after = [[s // n for s in sums] if n else self.centroids[c] for c, (n, sums) in sorted(self.totals.items())]
        self.changed = [c for c, (a, b) in enumerate(zip(self.centroids, after, strict=True)) if a != b]
        self.centroids = after

    def owned(self) -> DataFrame:
        """(vec_id, cluster, distance) by the last pass."""
        uri, dimensions = self.state, self.dimensions

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for number, name in zip(batch.column("number").to_pylist(), batch.column("uri").to_pylist(), strict=True):
                    (owners, distances), row = _load(f"{uri}/{number}"), 0
                    for _, ids in _vectors(name, dimensions, ("vec_id",)):
                        some = slice(row, row + len(ids))
                        yield pa.RecordBatch.from_arrays([ids, pa.array(owners[some].astype(np.int32)), pa.array(distances[some].astype(np.int64))], names=["vec_id", "cluster", "distance"])
                        row += len(ids)

        schema = "vec_id long, cluster int, distance long"
        return self._tasks().mapInArrow(scan, schema) if self.files else self.spark.createDataFrame([], schema)


def _vectors(uri: str, dimensions: int, columns: tuple[str, ...] = ("x",)) -> Iterator[tuple[np.ndarray | None, pa.Array | None]]:
    """Vectors of a file, or their ids, in order and some thousands at a time."""
    import pyarrow.parquet as pq
    from pyarrow import fs as pafs

    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as source:
        for batch in pq.ParquetFile(source).iter_batches(HELD, columns=list(columns)):
            yield (_rows(batch.column("x"), dimensions), None) if "x" in columns else (None, batch.column("vec_id"))


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector (vec_id, embedding) that counts."""
    spark = vectors.sparkSession
    run = Clustering(vectors, dimensions, scale)
    storage.until_exit(run.uri)
    run.begin(clusters, seed)
    for _ in range(rounds):
        run.assign()
        run.move()
    inertia = run.assign()
    cut = lambda n: min(n, _LONG)
    facts = [(c, cut(i), cut(sum(inertia.values())), digest(run.centroids[c])) for c, i in inertia.items()]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return run.owned().join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row a cluster


def oracle(dimensions: int = DIMENSIONS, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> str:
    """The same in SQL, round by round over all pairs of vectors and centroids."""
    steps = [f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimensions}),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1)::INTEGER AS c, x AS m FROM v QUALIFY c < {clusters})"""]  # fmt: skip
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, any_value(x) AS x, arg_min(c, d * {clusters} + c) AS c, min(d)::BIGINT AS d
  FROM (SELECT vec_id, x, c, list_sum(list_transform(list_zip(x, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{r}) GROUP BY vec_id)""")
        if r < rounds:
            steps.append(f"""s{r} AS MATERIALIZED (SELECT c, i, sum(v)::BIGINT AS s, count(*)::BIGINT AS n FROM (SELECT c, unnest(x) AS v, unnest(range({dimensions})) AS i FROM a{r}) GROUP BY c, i),
c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(f.m, c{r}.m) AS m FROM c{r} LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM s{r} GROUP BY c) f ON f.c = c{r}.c)""")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, a{rounds}.c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a{rounds}.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (c)"""
