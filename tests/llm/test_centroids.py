"""Centroid clustering against plain integer k-means, and on odd rows."""

from hashlib import sha256

import numpy as np
import pytest

from meterlight.llm import centroids as c

SCHEMA = "vec_id long, embedding array<float>, cluster int, distance long, code string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)


def plain(rows, rounds=c.ROUNDS):
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid) with Python's integers."""
    kept = [(i, [max(min(int(np.floor(1024 * float(np.float32(x)))), c.MOST), -c.MOST) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return []
    centers = [v for _, v in sorted(kept, key=lambda r: (sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:8]]
    vectors = np.array([v for _, v in kept], object)

    def nearest():
        d = np.stack([((vectors - np.array(m, object)) ** 2).sum(axis=1) for m in centers], axis=1)
        return [min(range(len(centers)), key=lambda k: (row[k], k)) for row in d], d

    for _ in range(rounds):
        cluster, _ = nearest()
        for k in range(len(centers)):
            own = vectors[[x == k for x in cluster]]
            if len(own):
                centers[k] = [int(s) // len(own) for s in own.sum(axis=0)]
    cluster, d = nearest()
    distance = [int(d[i][k]) for i, k in enumerate(cluster)]
    inertia = [sum(x for x, k in zip(distance, cluster) if k == j) for j in range(len(centers))]
    return [(i, k, x, inertia[k], sum(inertia), list(centers[k])) for (i, _), k, x in zip(kept, cluster, distance)]


def result(df):
    return sorted([(r[0], r[1], r[2], r[3], r[4], list(r[5])) for r in df.collect()], key=str)


def vectors(seed, n, groups=5, spread=0.1):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 0.3, (groups, 64))
    return [(i, (middle[i % groups] + rng.normal(0, spread, 64)).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("spread", [0.01, 0.1, 0.6])
def test_against_plain(spark, spread):
    rows = vectors(1, 300, spread=spread)
    assert result(c.clustered(frame(spark, rows))) == sorted(plain(rows), key=str)


def test_odd_rows(spark):
    """Nulls, wrong sizes, NaN, infinities, repeated ids and vectors, ties, huge components."""
    rows = vectors(2, 30)
    v = rows[0][1]
    rows += [(None, v), (5, v), (5, v), (31, None), (32, []), (33, v[:63]), (34, v + [0.0]), (35, [*v[:63], None]), (36, [*v[:63], float("nan")])]
    rows += [(37, [*v[:63], float("-inf")]), (38, [0.0] * 64), (39, [3e38] * 64), (40, [-3e38] * 64)] + [(41 + i, [0.5] * 64) for i in range(100)]
    assert result(c.clustered(frame(spark, rows))) == sorted(plain(rows), key=str)


def test_few_and_equal_vectors(spark):
    for rows in ([(1, [0.25] * 64)], [(i, [0.25] * 64) for i in range(20)], [(i, [float(i)] * 64) for i in range(3)]):
        assert result(c.clustered(frame(spark, rows))) == sorted(plain(rows), key=str)
    assert c.clustered(frame(spark, [])).collect() == []
    assert c.clustered(frame(spark, [(1, [1.0]), (2, None)])).collect() == []


def test_cells_hold_their_vectors():
    rng = np.random.default_rng(3)
    given = rng.integers(-900, 900, (500, 64))
    cells = c.Cells(given.min(axis=0).tolist(), given.max(axis=0).tolist())
    codes = cells.of(given)
    assert codes.max() < 1 << c.CELL_BITS
    assert (c.unpacked(c.packed(codes)) == codes).all()
    centers = given[:8]
    exact = c.distances(given, centers)
    known = c.Intervals(cells, centers)
    at = codes.astype(int) + cells.offsets
    for b in range(8):
        for k in range(8):
            assert (known.farther[b, k][at].sum(axis=1) <= exact[:, k] - exact[:, b]).all()
    near = known(codes)
    sure = near >= 0
    assert sure.any() and (near[sure] == exact.argmin(axis=1)[sure]).all()


def test_only_open_vectors_are_fetched(spark):
    """Well-parted groups are told apart by their cells; the JVM sends no vector of those on."""
    rows = vectors(4, 400, groups=8, spread=0.005)
    table, cells = c.va_file(frame(spark, rows))
    now = c.first_centroids(table)
    near = table.withColumn("near", c._near(cells, now)("code"))
    assert near.where("near >= 0").count() > 100
    plan = near.where("near < 0").select("vec")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "Exchange" not in plan
