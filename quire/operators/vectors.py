"""Vector search by cosine distance: exact, for one query by higher-order functions, for many in matrix blocks; and by an
inverted file of cells around centroids, of which a query looks into a few."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries of one pass: their matrix is broadcast.
QUERY_BLOCK = 4096


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision; null where lengths differ or a value is missing."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for a vector of length zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def nearest(vectors: DataFrame, query: list[float], limit: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(rank, key, distance): the `limit` nearest rows by cosine distance, ties by key."""
    wanted = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select(key, F.round(1 - cosine(F.col(vector), wanted), 9).alias("distance")).where("distance IS NOT NULL")
    best = scored.orderBy("distance", key).limit(max(0, limit))
    return best.select(F.row_number().over(Window.orderBy("distance", key)).cast("bigint").alias("rank"), key, "distance")


def nearest_batch(vectors: DataFrame, queries: DataFrame, limit: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query, key, distance, rank): the `limit` nearest rows of every query row, itself included.

    Queries go in blocks of QUERY_BLOCK, whose matrix is broadcast; each partition hands on its nearest rows per query,
    so what is shuffled does not grow with the vectors. Null vectors and ones of another length have no rows.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    names, rows, out = [], [], None

    def block_found(names: list, rows: list) -> DataFrame:
        matrix = np.array(rows, dtype=np.float64)
        matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
        shared = spark.sparkContext.broadcast((names, matrix))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, matrix = shared.value
            best_keys = [[] for _ in names]
            key_type = None
            for batch in batches:
                key_type = batch.schema.field(0).type
                kept = [(k, v) for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if v is not None and len(v) == matrix.shape[1] and None not in v]
                if not kept:
                    continue
                own = np.array([v for _, v in kept], dtype=np.float64)
                length = np.linalg.norm(own, axis=1)
                live = np.flatnonzero(length > 0)
                if not len(live):
                    continue
                distance = np.round(1 - (matrix @ (own[live] / length[live, None]).T), 9)
                width = min(limit, len(live))
                for q in range(len(names)):
                    edge = np.partition(distance[q], width - 1)[width - 1]
                    best_keys[q] += [(float(distance[q, c]), kept[live[c]][0]) for c in np.flatnonzero(distance[q] <= edge)]
                    if len(best_keys[q]) > 4 * limit:
                        best_keys[q] = sorted(best_keys[q])[:limit]
            found = [(names[q], k, d) for q, best in enumerate(best_keys) for d, k in sorted(best)[:limit]]
            if key_type is not None:
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], key_type), pa.array([f[1] for f in found], key_type), pa.array([f[2] for f in found], pa.float64())], names=["query", "k", "distance"])

        return vectors.select(key, vector).mapInArrow(run, f"query {kind}, k {kind}, distance double")

    for row in queries.select(key, vector).where(F.col(vector).isNotNull()).orderBy(key).toLocalIterator():
        names.append(row[0])
        rows.append(row[1])
        if len(names) == QUERY_BLOCK:
            found = block_found(names, rows)
            out, names, rows = (found if out is None else out.unionAll(found)), [], []
    if names:
        found = block_found(names, rows)
        out = found if out is None else out.unionAll(found)
    if out is None:
        return spark.createDataFrame([], f"query {kind}, {key} {kind}, distance double, rank bigint")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "k")).cast("bigint")
    return out.withColumn("rank", rank).where(F.col("rank") <= limit).select("query", F.col("k").alias(key), "distance", "rank")


# ------------------------------------------------------------------------------------------------ inverted file

#: Vectors that centroids are fitted on, at most; how many centroids at most; rounds of fitting.
SAMPLE, MOST_CELLS, ROUNDS = 20_000, 1024, 12
#: Cells that a query looks into are chosen so that of the neighbours of so many vectors this share is found.
CALIBRATION, TARGET = 100, 0.95


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def fit_cells(vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE, key: str = "vec_id", vector: str = "embedding") -> np.ndarray:
    """Unit centroids by spherical k-means on at most `sample` vectors, those of smallest hash of their key.

    Without `cells`, the root of the sample's size, so the centroids are bounded by it. An empty table gives none.
    """
    hashed = vectors.where(F.col(vector).isNotNull()).select(vector, F.xxhash64(key).alias("h"), key).orderBy("h", key).limit(sample)
    rows = [r[0] for r in hashed.toLocalIterator()]
    width = max(map(len, rows), default=0)
    data = _unit(np.array([r for r in rows if len(r) == width and None not in r and any(r)], dtype=np.float64).reshape(-1, max(width, 1)))
    if not len(data):
        return np.zeros((0, max(width, 1)))
    count = min(len(data), cells or max(1, min(MOST_CELLS, round(len(data) ** 0.5))))
    centroids = data[np.linspace(0, len(data) - 1, count).astype(int)].copy()
    for _ in range(ROUNDS):
        of = np.argmax(data @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, of, data)
        alive = np.linalg.norm(sums, axis=1) > 0
        centroids[alive] = _unit(sums[alive])
    return centroids


def placed_in_cells(vectors: DataFrame, centroids: np.ndarray, key: str = "vec_id", vector: str = "embedding", probes: int = 1) -> DataFrame:
    """(key, unit, cell): every vector at length one in its nearest cell, or as often as `probes` in its nearest ones.

    Null vectors, ones of another length, with a null or of length zero have no row: their distance is none either.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)
    kind = vectors.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        for batch in batches:
            kept = [(k, v) for k, v in enumerate(batch.column(1).to_pylist()) if v is not None and len(v) == centres.shape[1] and None not in v and any(v)]
            if not kept or not len(centres):
                continue
            own = _unit(np.array([v for _, v in kept], dtype=np.float64))
            near = np.argsort(-(own @ centres.T), axis=1, kind="stable")[:, : min(probes, len(centres))]
            rows = np.repeat(np.array([k for k, _ in kept]), near.shape[1])
            units = pa.array(list(np.repeat(own, near.shape[1], axis=0)), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), units, pa.array(near.ravel().astype(np.int32))], names=[key, "unit", "cell"])

    return vectors.select(key, vector).mapInArrow(run, f"`{key}` {kind}, unit array<double>, cell int")


def nearest_in_cells(index: DataFrame, queries: DataFrame, centroids: np.ndarray, limit: int, probes: int | None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query, key, distance, rank): the `limit` nearest rows of `index` (placed_in_cells) in the `probes` cells nearest to
    each query; with `probes` None in all of them, which is exact.

    Queries meet the rows of their cells only, in a join on the cell; a cell of many rows is split by Spark as any skewed
    key is. An index stored by cell is read in the parts that the queries name.
    """
    asked = placed_in_cells(queries, centroids, key, vector, len(centroids) if probes is None else probes).select(F.col(key).alias("query"), F.col("unit").alias("wanted"), "cell")
    met = index.join(asked, "cell").select("query", F.col(key), F.round(1 - dot(F.col("unit"), F.col("wanted")), 9).alias("distance"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", key)).cast("bigint")
    return met.withColumn("rank", rank).where(F.col("rank") <= limit).select("query", key, "distance", "rank")


def calibrated_probes(vectors: DataFrame, index: DataFrame, centroids: np.ndarray, limit: int, target: float = TARGET, sample: int = CALIBRATION, key: str = "vec_id", vector: str = "embedding") -> int:
    """How many cells a query has to look into to find the share `target` of its `limit` exact neighbours, as measured on
    `sample` vectors of smallest hash of their key. Vectors of no structure take many, clustered ones few."""
    asked = vectors.where(F.col(vector).isNotNull()).withColumn("_h", F.xxhash64(key)).orderBy(F.col("_h").desc(), key).limit(sample).select(key, vector)
    held = nearest_batch(vectors, asked, limit, key, vector).join(index.select(F.col(key), "cell").dropDuplicates([key]), key).select("query", "cell").toLocalIterator()
    order = {r[0]: np.argsort(np.argsort(-(_unit(np.array([r[1]], dtype=np.float64)) @ centroids.T)[0], kind="stable")) for r in asked.toLocalIterator() if r[1] and len(r[1]) == centroids.shape[1] and None not in r[1]}
    ranks = sorted(int(order[query][cell]) for query, cell in held if query in order)
    return 1 + ranks[min(len(ranks) - 1, int(np.ceil(target * len(ranks))) - 1)] if ranks else 1


def recall(found: DataFrame, exact: DataFrame, key: str = "vec_id") -> DataFrame:
    """One row: queries, and the share of the exact neighbours that are found."""
    hits = exact.select("query", key).join(found.select("query", key).withColumn("hit", F.lit(1)), ["query", key], "left")
    return hits.agg(F.countDistinct("query").alias("queries"), F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("recall"))
