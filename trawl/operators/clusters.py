"""Exact vector search over clusters: partitions whose every vector is too far away are not read.

Vectors are stored as unit vectors in a partition for their nearest centre, with the cluster's radius, the largest
distance of a member from the centre.  By the triangle inequality no member is nearer to a query than the centre's
distance less the radius; a search reads the nearest clusters until it has ``k`` results, and then only those
clusters whose bound lets them hold a better one.  Centres are fitted on at most ``FIT`` vectors; they decide how much
is pruned, never what is found.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ty

from ..functions.vector import cosine

FIT, ROUNDS, SLACK = 20_000, 8, 1e-9


@dataclass
class Found:
    """The best vectors, and how many of the clusters were read."""

    rows: DataFrame
    read: int
    clusters: int

    @property
    def pruned(self) -> float:
        return 1 - self.read / self.clusters if self.clusters else 0.0


def unit(x: np.ndarray) -> np.ndarray:
    norms = np.sqrt((x * x).sum(axis=1))
    return x / np.where(norms > 0, norms, 1.0)[:, None]


def centres(vectors: DataFrame, vec_col: str, dims: int, count: int, seed: int = 1) -> np.ndarray:
    """Up to ``count`` centres: spread over a bounded sample by distance, then moved to the means of their members."""
    rows = vectors.where(F.size(vec_col) == dims)
    n = rows.count()
    sample = rows.sample(min(1.0, 1.2 * FIT / max(1, n)), seed).limit(FIT).select(vec_col).toArrow()
    x = unit(np.array(sample.column(0).to_pylist(), float).reshape(-1, dims))
    rng = np.random.default_rng(seed)
    chosen = [x[rng.integers(len(x))]] if len(x) else []
    far = np.full(len(x), np.inf)
    while len(chosen) < min(count, len(x)):
        far = np.minimum(far, ((x - chosen[-1]) ** 2).sum(axis=1))
        if not far.max() > 1e-12:
            break
        chosen.append(x[rng.choice(len(x), p=far / far.sum())])
    c = np.array(chosen).reshape(-1, dims)
    for _ in range(ROUNDS if len(c) else 0):
        near = (x @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1)
        c = np.array([x[near == k].mean(axis=0) if (near == k).any() else c[k] for k in range(len(c))])
    return c


class Clusters:
    """``path``: vectors in folders by cluster, a table of the centres, and one of radii for each part that was added."""

    def __init__(self, spark: SparkSession, path: str, id_col: str = "vec_id", vec_col: str = "embedding"):
        self.spark, self.path, self.id_col, self.vec_col = spark, path.rstrip("/"), id_col, vec_col

    @classmethod
    def build(cls, vectors: DataFrame, path: str, count: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> Clusters:
        """A new table of ``vectors``; those whose length is not the most frequent one form a cluster of their own (-1), which every search reads."""
        out = cls(vectors.sparkSession, path, id_col, vec_col)
        sizes = vectors.groupBy(F.size(vec_col).alias("d")).count().where("d > 0").orderBy(F.desc("count"), "d").first()
        dims, n = (sizes["d"], sizes["count"]) if sizes else (0, 0)
        c = centres(vectors, vec_col, dims, count or max(1, min(4096, round(n**0.5)))) if dims else np.zeros((0, 0))
        rows = [(k, [float(v) for v in row]) for k, row in enumerate(c)]
        out.spark.createDataFrame(rows, "cluster int, centre array<double>").coalesce(1).write.parquet(f"{out.path}/centres")
        out.add(vectors)
        return out

    def centre_rows(self) -> np.ndarray:
        rows = sorted(self.spark.read.parquet(f"{self.path}/centres").collect(), key=lambda r: r["cluster"])
        return np.array([r["centre"] for r in rows], float)

    def add(self, vectors: DataFrame) -> None:
        """Adds vectors; the radius of each cluster grows with them.  Radii are written after the vectors' task has stored them."""
        c, id_type = self.centre_rows(), vectors.schema[self.id_col].dataType
        schema = ty.StructType([ty.StructField(self.id_col, id_type), ty.StructField(self.vec_col, ty.ArrayType(ty.DoubleType())), ty.StructField("cluster", ty.IntegerType()), ty.StructField("distance", ty.DoubleType())])
        dims = c.shape[1] if len(c) else 0

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = batch.column(1)
                fits = np.array([x is not None and len(x) == dims and dims > 0 for x in v.to_pylist()], bool)
                near, distance = np.full(len(v), -1, np.int32), np.zeros(len(v))
                if fits.any():
                    x = unit(v.take(pa.array(np.flatnonzero(fits))).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
                    best = (x @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1)
                    near[fits], distance[fits] = best, np.sqrt(((x - c[best]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([batch.column(0), v, pa.array(near), pa.array(distance)], schema.names)

        part = uuid.uuid4().hex
        rows = vectors.select(self.id_col, F.col(self.vec_col).cast("array<double>").alias(self.vec_col)).mapInArrow(assign, schema)
        rows.repartition("cluster", F.pmod(F.xxhash64(self.id_col), F.lit(4))).write.partitionBy("cluster").parquet(f"{self.path}/vectors/part={part}")
        stored = self.spark.read.parquet(f"{self.path}/vectors/part={part}") if self._any(f"{self.path}/vectors/part={part}") else rows
        stored.groupBy("cluster").agg(F.max("distance").alias("radius"), F.count(F.lit(1)).alias("n")).coalesce(1).write.parquet(f"{self.path}/radii/part={part}")

    def _any(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return any(x.isDirectory() for x in p.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(p))

    def rows(self) -> DataFrame:
        schema = f"{self.id_col} {self._id_type()}, {self.vec_col} array<double>, distance double, part string, cluster int"
        return self.spark.read.schema(schema).parquet(f"{self.path}/vectors")

    def _id_type(self) -> str:
        from_disk = self.spark.read.option("mergeSchema", False).parquet(f"{self.path}/vectors").schema
        return from_disk[self.id_col].dataType.simpleString()

    def search(self, query: list[float], k: int, digits: int = 6) -> Found:
        """The ``k`` vectors of the largest cosine (rounded to ``digits``; ties to smaller ids), as (id, score), exact."""
        radii = {r["cluster"]: (r["radius"], r["n"]) for r in self.spark.read.parquet(f"{self.path}/radii").groupBy("cluster").agg(F.max("radius").alias("radius"), F.sum("n").alias("n")).collect()}
        c, q = self.centre_rows(), unit(np.array([query], float))[0] if len(query) else np.zeros(0)
        whole = {-1} & set(radii)
        if not len(c) or c.shape[1] != len(q) or not np.abs(q).sum() > 0:  # nothing can be told from distances
            return Found(self._best(self.rows(), query, k, digits), len(radii), len(radii))
        bound = {j: max(0.0, float(np.sqrt(((q - c[j]) ** 2).sum())) - r) for j, (r, _) in radii.items() if j >= 0}
        near, first, have = sorted(bound, key=lambda j: (bound[j], j)), set(whole), 0
        for j in near:
            if have >= k:
                break
            first.add(j)
            have += radii[j][1]
        found = self._best(self.rows().where(F.col("cluster").isin(sorted(first))), query, k, digits).collect()
        # a cosine s is a distance of sqrt(2 - 2 s); zero vectors have cosine 0 and stand at the origin, at distance 1
        least = found[-1]["score"] - 2 * 10.0**-digits if len(found) == k else -1.0
        reach = max(1.0, np.sqrt(max(0.0, 2 - 2 * least))) if least <= 0 else np.sqrt(max(0.0, 2 - 2 * least))
        read = first | {j for j in near if bound[j] <= reach + SLACK}
        return Found(self._best(self.rows().where(F.col("cluster").isin(sorted(read))), query, k, digits), len(read), len(radii))

    def _best(self, rows: DataFrame, query: list[float], k: int, digits: int) -> DataFrame:
        score = F.round(cosine(F.col(self.vec_col), F.array(*[F.lit(float(x)) for x in query])), digits).alias("score")
        return rows.select(self.id_col, score).orderBy(F.desc("score"), self.id_col).limit(k)
