"""Centroid clustering with a VA-file: cells of a few bits give distance intervals, full vectors settle the rest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlight.llm.common import arrow_map, held

SIZE = 64
SCALE = 1024
CLUSTERS, ROUNDS = 8, 10
#: Bits of a cell; each dimension has so many cells of equal width between its least and greatest value. On
#: the check tables intervals overlap for 9 to 14 % of the vectors with 8 bits, 44 to 55 % with 6.
CELL_BITS = 8
#: Larger components count as this: sums of squares of larger differences are no longs.
MOST = (1 << 26) - 1
#: Inertias beyond it count as this.
LONGEST = (1 << 63) - 1
#: Vectors that are looked at together.
ROWS = 4096


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vec) of the vectors with exactly 64 components, all of them finite, as integers floor(1024 * x)."""
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("x", lambda x: F.least(F.greatest(F.floor(F.least(F.greatest(x, F.lit(-1e9)), F.lit(1e9)) * SCALE), F.lit(-MOST)), F.lit(MOST)).cast("int"))
    return given.where(F.size("x") == SIZE).where(finite).select("vec_id", whole.alias("vec"))


def _whole(column: pa.ListArray) -> np.ndarray:
    """The vectors of a column, a row each."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, SIZE).astype(np.int64)


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of each vector to each centroid, exactly."""
    return np.stack([((vectors - c) ** 2).sum(axis=1) for c in centroids], axis=1)


class Cells:
    """The cells of each dimension: number k holds the integers from edges[k] to edges[k + 1] - 1."""

    def __init__(self, low: list[int], high: list[int]) -> None:
        cells = 1 << CELL_BITS
        self.low = np.array(low, np.int64)
        self.width = np.maximum(-(-(np.array(high, np.int64) - self.low + 1) // cells), 1)
        self.offsets = np.arange(SIZE) * cells

    def of(self, vectors: np.ndarray) -> np.ndarray:
        return ((vectors - self.low) // self.width).astype(np.uint8)

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        """(first, last) integer of each cell of each dimension."""
        first = self.low[:, None] + self.width[:, None] * np.arange(1 << CELL_BITS)
        return first, first + self.width[:, None] - 1


class Intervals:
    """Nearest centroids from cells alone.

    Lookup tables hold, for each dimension and cell, the distance to the middle of the cell and the
    interval of how much farther one centroid is than another. Most of the uncertainty
    of two distances is the same in both, so the interval of their difference is far narrower than
    those of the two.
    """

    def __init__(self, cells: Cells, centroids: np.ndarray) -> None:
        self.offsets = cells.offsets
        first, last = cells.ends()
        n, c = len(centroids), centroids[:, :, None]
        self.middle = ((first + last - 2 * c) ** 2).reshape(n, -1)
        # (x - a)**2 - (x - b)**2 = (a - b) * (a + b - 2 x) changes one way with x: its least value is at an end.
        self.farther = np.empty((n, n, self.middle.shape[1]), np.int64)
        for b in range(n):
            by = (c - c[b]) * (c + c[b])
            self.farther[b] = np.minimum(by - 2 * (c - c[b]) * first, by - 2 * (c - c[b]) * last).reshape(n, -1)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        """The nearest centroid of each vector, -1 where intervals overlap."""
        at = codes.astype(np.int64) + self.offsets
        best = np.stack([np.take(t, at).sum(axis=1) for t in self.middle], axis=1).argmin(axis=1)
        sure = np.ones(len(at), bool)
        for b in range(len(self.middle)):
            of = np.flatnonzero(best == b)
            for k in range(len(self.middle)):
                if k != b and len(of):
                    of = of[np.take(self.farther[b, k], at[of]).sum(axis=1) > 0]
            own = best == b
            own[of] = False
            sure[own] = False
        return np.where(sure, best, -1).astype(np.int16)


def packed(codes: np.ndarray) -> list[bytes]:
    """A value for each vector, a byte for each of its cells."""
    return [r.tobytes() for r in codes]


def unpacked(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.uint8).reshape(len(values), SIZE)


def va_file(vectors: DataFrame) -> tuple[DataFrame, Cells | None]:
    """A written table (vec_id, code, vec) of the usable vectors, and its cells."""
    own = usable(vectors)
    ends = own.select(*(f(F.col("vec")[d]).alias(f"{f.__name__}{d}") for f in (F.min, F.max) for d in range(SIZE))).first()
    if ends is None or ends[0] is None:
        return held(own.select("vec_id", F.lit(b"").alias("code"), "vec"), "va-file"), None
    cells = Cells(ends[:SIZE], ends[SIZE:])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                some = b.slice(at, ROWS)
                yield {"vec_id": some.column("vec_id"), "code": packed(cells.of(_whole(some.column("vec")))), "vec": some.column("vec")}

    return held(arrow_map(own, each, "vec_id long, code binary, vec array<int>"), "va-file"), cells


def first_centroids(table: DataFrame) -> np.ndarray:
    """The vectors with the smallest hashes of ``3:<vec_id>``; of equal ids those with the least components."""
    name = F.sha2(F.concat(F.lit("3:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = table.select(name.alias("name"), "vec").orderBy("name", "vec").limit(CLUSTERS).collect()
    return np.array([r["vec"] for r in rows], np.int64).reshape(-1, SIZE)


def _near(cells: Cells, centroids: np.ndarray):
    """A function of the codes alone: what stands beside them stays in the JVM."""

    @F.pandas_udf("short")
    def near(codes: pd.Series) -> pd.Series:
        nearest, out = Intervals(cells, centroids), []
        for at in range(0, len(codes), ROWS):
            out.append(nearest(unpacked(codes.iloc[at : at + ROWS].tolist())))
        return pd.Series(np.concatenate(out) if out else np.empty(0, np.int16))

    return near


def _settled(vectors: np.ndarray, near: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroids: those the cells gave, and by exact distances where they gave none."""
    out, open_ = near.copy(), near < 0
    out[open_] = distances(vectors[open_], centroids).argmin(axis=1)
    return out


def _moves(table: DataFrame, cells: Cells, before: np.ndarray | None, now: np.ndarray) -> np.ndarray:
    """What the assignment to ``now`` changes in (sum of each dimension, number) of each cluster.

    A full vector is fetched only if its intervals overlap or its cluster changes; without
    ``before`` all are new.
    """
    spread = table.select("code", "vec").withColumn("now", _near(cells, now)("code"))
    spread = spread.withColumn("before", F.lit(-2).cast("short") if before is None else _near(cells, before)("code"))
    fetched = spread.where("now < 0 or before < 0 or now != before").select("vec", "now", "before")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total = np.zeros((len(now), SIZE + 1), np.int64)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                some = b.slice(at, ROWS)
                vectors = _whole(some.column("vec"))
                given = np.concatenate((vectors, np.ones((len(vectors), 1), np.int64)), axis=1)
                to = _settled(vectors, some.column("now").to_numpy(), now)
                out = None if before is None else _settled(vectors, some.column("before").to_numpy(), before)
                moved = np.full(len(to), True) if before is None else to != out
                np.add.at(total, to[moved], given[moved])
                if before is not None:
                    np.subtract.at(total, out[moved], given[moved])
            # A batch has at most some thousands of rows and components are bounded, so that longs hold the sums.
            k, d = np.nonzero(total)
            yield {"k": k, "d": d, "change": total[k, d]}
            total[:] = 0

    changes = arrow_map(fetched, each, "k int, d int, change long").groupBy("k", "d").agg(F.sum(F.col("change").cast("decimal(20,0)")).alias("change"))
    out = np.zeros((len(now), SIZE + 1), object)
    for r in changes.collect():  # at most a number for each cluster and dimension
        out[r["k"], r["d"]] = int(r["change"])
    return out


def clustered(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """A row per usable vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid.

    Usable are vectors of 64 components, none of them null, NaN or infinite; each component x
    becomes floor(1024 * x), those beyond 2**26 in size count as 2**26 - 1. The first centroids are
    the 8 vectors with the smallest sha256 of ``3:<vec_id>`` (a null id: ``3:``; fewer vectors:
    fewer centroids). Each round assigns every vector to its nearest centroid (ties: the smaller
    number) and replaces those that have vectors by floor(sum / count). Repeated rows count each
    time. Without usable vectors the result is empty. Other columns are not read.

    Vectors are written once, with a cell of 8 bits for each dimension beside them. A round reads the
    cells, looks up intervals of how much farther each centroid is than the one that looks nearest, and
    fetches full vectors where intervals overlap or the cluster changes: sums are kept and only
    changed. Only cells go to Python for all rows; of the vectors, read beside them, those fetched do. Rounds after one
    that moves no centroid would move none either and are left out. The driver holds the
    centroids and sums; nothing is shuffled but those.
    """
    table, cells = va_file(vectors)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<int>"
    if cells is None:
        return table.sparkSession.createDataFrame([], schema)
    before, now = None, first_centroids(table)
    sums = np.zeros((len(now), SIZE + 1), object)
    for _ in range(rounds):
        sums += _moves(table, cells, before, now)
        new = np.array([[int(x) // int(s[SIZE]) for x in s[:SIZE]] if s[SIZE] else c for s, c in zip(sums, now.tolist())], np.int64).reshape(-1, SIZE)
        before, now = now, new
        if (before == now).all():
            break

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                some = b.slice(at, ROWS)
                whole = _whole(some.column("vec"))
                cluster = _settled(whole, some.column("near").to_numpy(), now)
                distance = ((whole - now[cluster]) ** 2).sum(axis=1)
                yield {"vec_id": some.column("vec_id"), "cluster": pa.array(cluster.astype(np.int32)), "distance": pa.array(distance)}

    near = table.withColumn("near", _near(cells, now)("code")).select("vec_id", "vec", "near")
    assigned = held(arrow_map(near, each, "vec_id long, cluster int, distance long"), "clusters")
    inertia = {r["cluster"]: int(r["inertia"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()}  # at most CLUSTERS rows
    rows = [(k, min(n, LONGEST), min(sum(inertia.values()), LONGEST), now[k].tolist()) for k, n in inertia.items()]
    known = table.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<int>")
    return assigned.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


