"""Clustering: k-means steps and out-of-core clustering on sufficient statistics (N, SUM, SUMSQ).

Points are rows (id, vec array<double>). What the driver holds is bounded: one summary (n, sum, sumsq) for
each of the k (or 3 k) clusters, never points.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..sources.storage import fresh_path, materialize
from . import sketches


@dataclass
class Summary:
    """N, SUM, SUMSQ of one cluster."""

    n: int
    total: np.ndarray
    squares: np.ndarray

    @property
    def centre(self) -> np.ndarray:
        return self.total / self.n

    @property
    def sd(self) -> np.ndarray:
        return np.sqrt(np.maximum(self.squares / self.n - self.centre**2, 0))

    def plus(self, other: Summary) -> Summary:
        return Summary(self.n + other.n, self.total + other.total, self.squares + other.squares)


def sample(points: DataFrame, share: float, seed: int = 7) -> DataFrame:
    """Exactly int(n * share) points, without replacement, by seeded digest of the id."""
    n = int(points.count() * share)
    return points.orderBy(sketches.drawn("id", seed), "id").limit(n)


def first_centres(points: DataFrame, k: int, seed: int = 11) -> DataFrame:
    """id, vec of k points with distinct places by seeded digest (fewer if there are fewer)."""
    first = points.groupBy("vec").agg(F.min(F.struct(sketches.drawn("id", seed).alias("h"), F.col("id").alias("id"))).alias("x"))
    return first.orderBy("x.h", "x.id").limit(k).select("x.id", "vec")


def assign(points: DataFrame, centres: dict[int, np.ndarray], sds: dict[int, np.ndarray] | None = None) -> DataFrame:
    """id, vec, cluster, dist: the nearest centre, of equal ones the smallest cluster. sds: Mahalanobis.

    The centres come to every row as one broadcast array, so the plan does not grow with them.
    """
    shape = "array<struct<cluster:int,centre:array<double>,sd:array<double>>>"
    table = [(int(c), [float(x) for x in v], [float(x) for x in (v if sds is None else sds[c])]) for c, v in sorted(centres.items())]
    sets = points.sparkSession.createDataFrame([(table,)], f"_sets {shape}")
    far = (lambda x: vectors.euclidean(F.col("vec"), x["centre"])) if sds is None else (lambda x: vectors.mahalanobis(F.col("vec"), x["centre"], x["sd"]))
    each = F.transform("_sets", lambda x: F.struct(F.round(far(x), 9).alias("dist"), x["cluster"].alias("cluster")))
    found = points.select("id", "vec").join(F.broadcast(sets), F.lit(True)).select("id", "vec", F.array_min(each).alias("_n"))
    return found.select("id", "vec", F.col("_n.cluster").alias("cluster"), F.col("_n.dist").alias("dist"))


def statistics(assigned: DataFrame) -> DataFrame:
    """cluster, dim, n, sum, sumsq in long form."""
    each = assigned.select("cluster", F.posexplode("vec").alias("dim", "x"))
    return each.groupBy("cluster", "dim").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sum"), F.sum(F.expr("x * x")).alias("sumsq"))


def centres_sd(stats: DataFrame) -> DataFrame:
    """cluster, dim, mean, sd; a variance below 0 by rounding counts as 0."""
    mean = F.col("sum") / F.col("n")
    return stats.select("cluster", "dim", mean.alias("mean"), F.sqrt(F.greatest(F.col("sumsq") / F.col("n") - mean * mean, F.lit(0.0))).alias("sd"))


def merge_statistics(a: DataFrame, b: DataFrame) -> DataFrame:
    """Summaries of both, added by cluster and dimension."""
    return a.unionByName(b).groupBy("cluster", "dim").agg(*[F.sum(c).alias(c) for c in ("n", "sum", "sumsq")])


def summaries(assigned: DataFrame) -> dict[int, Summary]:
    rows = statistics(assigned).groupBy("cluster").agg(
        F.first("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("dim", "sum"))), lambda x: x["sum"]).alias("s"),
        F.transform(F.sort_array(F.collect_list(F.struct("dim", "sumsq"))), lambda x: x["sumsq"]).alias("q"),
    )
    return {r["cluster"]: Summary(r["n"], np.array(r["s"]), np.array(r["q"])) for r in rows.collect()}


def k_means(points: DataFrame, k: int, tolerance: int = 10, max_rounds: int = 100) -> tuple[DataFrame, dict[int, Summary]]:
    """Assignment and summaries; stops when no cluster's size changes by more than ``tolerance``.

    The first round compares with sizes of 0; clusters that lose all points disappear.
    """
    centres = {c: np.array(r["vec"], float) for c, r in enumerate(first_centres(points, k).collect())}
    sizes = dict.fromkeys(centres, 0)
    found = {}
    for _ in range(max_rounds):
        if not centres:
            break
        assigned = assign(points, centres)
        found = summaries(assigned)
        if all(abs(found[c].n - sizes.get(c, 0)) <= tolerance for c in found):
            break
        sizes, centres = {c: s.n for c, s in found.items()}, {c: s.centre for c, s in found.items()}
    if not found:
        return points.select("id", "vec", F.lit(None).cast("int").alias("cluster"), F.lit(0.0).alias("dist")), {}
    return assign(points, centres), found


def merge_clusters(source: dict[int, Summary], target: dict[int, Summary], threshold: float) -> dict[int, int]:
    """source cluster -> nearest target cluster within the threshold, by the target's sd at entry."""
    out = {}
    for c, s in sorted(source.items()):
        best = min(((_scaled(s.centre, t), k) for k, t in sorted(target.items())), default=None)
        if best is not None and best[0] < threshold:
            out[c] = best[1]
    return out


def _scaled(x: np.ndarray, t: Summary) -> float:
    sd = t.sd
    return float(np.sqrt((((x - t.centre) / np.where(sd == 0, 1, sd)) ** 2).sum()))


#: Columns of the round statistics.
ROUND = "round_id int, nof_cluster_discard int, nof_point_discard long, nof_cluster_compression int, nof_point_compression long, nof_point_retained long"


def out_of_core(points: DataFrame, k: int, share: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Labels (id, cluster or -1) and round statistics (ROUND) of a chunked pass over points (id, vec, chunk).

    The first chunk makes the discard set (k-means on a sample) and the compression set (k-means with 3 k
    on the rest; singletons are retained). In later chunks a point joins the nearest discard cluster
    within 3 sqrt(d), else the nearest compression cluster within it, else it is retained. In the end the
    retained points are clustered (3 k), these clusters merge into compression clusters in reach, and
    compression clusters into discard clusters in reach; all points of other clusters get -1.

    The points are written once, by chunk, and each chunk is read alone. The driver holds summaries only.
    """
    spark = points.sparkSession
    path = fresh_path(spark, "chunks")
    points.select("id", "vec", "chunk").write.partitionBy("chunk").parquet(path)
    kinds = dict(points.dtypes)
    table = spark.read.schema(f"id {kinds['id']}, vec {kinds['vec']}, chunk {kinds['chunk']}").parquet(path)
    chunks = [r["chunk"] for r in table.select("chunk").distinct().orderBy("chunk").collect()]
    parts, rounds, discard, compressed, retained, reach = [], [], {}, {}, [], 0.0
    for number, chunk in enumerate(chunks):
        here = table.where(F.col("chunk").eqNullSafe(F.lit(chunk))).select("id", "vec")
        reach = 3 * float(np.sqrt(len(here.first()["vec"])))
        if number == 0:
            first = materialize(sample(here, share), "sample")
            labelled, discard = k_means(first, k)
            parts.append(labelled.select("id", F.lit("d").alias("set"), "cluster"))
            labelled, found = k_means(materialize(here.join(first.select("id"), "id", "left_anti"), "rest"), 3 * k, 25)
            alone = F.col("cluster").isin([c for c, s in found.items() if s.n == 1] or [-1])
            compressed = {c: s for c, s in found.items() if s.n > 1}
            parts.append(labelled.where(~alone).select("id", F.lit("c").alias("set"), "cluster"))
            left = labelled.where(alone).select("id", "vec")
        else:
            left = here
            for name, sets in (("d", discard), ("c", compressed)):
                if sets:
                    near = materialize(assign(left, {c: s.centre for c, s in sets.items()}, {c: s.sd for c, s in sets.items()}), "near")
                    taken = near.where(F.col("dist") < reach)
                    for c, s in summaries(taken).items():
                        sets[c] = sets[c].plus(s)
                    parts.append(taken.select("id", F.lit(name).alias("set"), "cluster"))
                    left = near.where(F.col("dist") >= reach).select("id", "vec")
        retained.append(materialize(left, "retained"))
        kept = sum(r[-1] for r in rounds[-1:]) + retained[-1].count()
        rounds.append((number + 1, len(discard), sum(s.n for s in discard.values()), len(compressed), sum(s.n for s in compressed.values()), kept))
    stats = spark.createDataFrame(rounds, ROUND)
    if not rounds:
        return points.select("id", F.lit(-1).alias("cluster")), stats
    into: dict[int, int] = {}
    if rounds[-1][-1]:
        labelled, found = k_means(reduce(DataFrame.unionByName, retained), 3 * k)
        into = merge_clusters(found, compressed, reach)
        parts.append(labelled.select("id", F.lit("r").alias("set"), "cluster"))
        for c, target in into.items():
            compressed[target] = compressed[target].plus(found[c])
    up = merge_clusters(compressed, discard, reach)
    ends = [(s, int(c), int(x)) for s, pairs in (("c", up), ("r", {c: up[t] for c, t in into.items() if t in up})) for c, x in pairs.items()]
    ends = spark.createDataFrame(ends, "set string, cluster int, label int")
    labels = reduce(DataFrame.unionByName, parts).join(F.broadcast(ends), ["set", "cluster"], "left")
    return labels.select("id", F.when(F.col("set") == "d", F.col("cluster")).otherwise(F.coalesce("label", F.lit(-1))).alias("cluster")), stats
