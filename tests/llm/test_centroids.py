"""Centroid clustering against a plain loop in whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

pytest.importorskip("fieldstrata.llm")

from fieldstrata.llm import centroids  # noqa: E402

KINDS = "vec_id long, embedding array<float>, label int, cluster int, distance int, x int"


def brute(rows, k, rounds, dims):
    kept = [(i, [math.floor(1024 * float(np.float32(v))) for v in e]) for i, e in rows if e is not None and len(e) == dims and all(v is not None and math.isfinite(v) for v in e)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centre = [x for _, x in order[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), n) for n, c in enumerate(centre))

    for _ in range(rounds):
        members = {}
        for _, x in kept:
            members.setdefault(nearest(x)[1], []).append(x)
        centre = [[sum(col) // len(members[n]) for col in zip(*members[n], strict=True)] if n in members else c for n, c in enumerate(centre)]
    out = [(i, *nearest(x)) for i, x in kept]
    inertia = {n: sum(d for _, d, m in out if m == n) for _, _, n in out}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centre]
    return sorted((repr(i), n, d, inertia[n], sum(inertia.values()), digest[n]) for i, d, n in out)


def got(df):
    return sorted((repr(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, e, 0, 1, 2, 3) for i, e in rows], KINDS)


@pytest.mark.parametrize("pivots", [1, 16])
def test_clusters(spark, pivots):
    """Ties, repeated rows, null and repeated ids, wrong lengths, nulls and non-finite components, clashing columns."""
    rng = random.Random(4)
    rows = [(i, [rng.choice([-0.5, -0.001, 0.0, 0.25, 0.5]) + rng.choice([0, 0.001]) for _ in range(4)]) for i in range(200)]
    rows += rows[:30] + [(None, [0.1, 0.2, 0.3, 0.4]), (None, [0.1, 0.2, 0.3, 0.4]), (5, [-0.3] * 4), (300, [0.1] * 3), (301, [0.1] * 5), (302, None), (303, [0.1, None, 0.1, 0.1]), (304, [float("nan")] * 4), (305, [float("inf"), 0.0, 0.0, 0.0]), (306, [])]
    assert got(centroids.cluster(frame(spark, rows).repartition(3), 8, 10, 4, pivots=pivots, sample=50)) == brute(rows, 8, 10, 4)


def test_few_and_none(spark):
    """Fewer vectors than centroids, equal vectors only, no vectors."""
    few = [(1, [0.1, 0.2]), (2, [0.1, 0.2]), (None, [9.0, -9.0])]
    assert got(centroids.cluster(frame(spark, few), 8, 3, 2)) == brute(few, 8, 3, 2)
    same = [(i, [0.5, 0.5]) for i in range(9)]
    assert got(centroids.cluster(frame(spark, same), 3, 3, 2)) == brute(same, 3, 3, 2)
    assert centroids.cluster(frame(spark, [(1, [0.1])]), 8, 3, 2).count() == 0
    with pytest.raises(Exception, match="or more after scaling"):
        centroids.cluster(frame(spark, [(1, [1e30, 0.0])]), 2, 1, 2).count()


def test_pivots_spare_distances():
    """Bounds leave out distances and change nothing."""
    rng = np.random.default_rng(5)
    middle = rng.integers(-1000, 1000, (8, 64))
    x = middle[rng.integers(0, 8, 3000)] + rng.integers(-40, 40, (3000, 64))
    pivots = centroids.pivots_of(x[:500], 16)
    d = np.stack([centroids.squared(x, p[None]) for p in pivots], 1)
    cluster, best, exact = centroids.assign(x, d, middle, pivots)
    every = np.stack([centroids.squared(x, c[None]) for c in middle], 1)
    assert (cluster == every.argmin(1)).all() and (best == every.min(1)).all()
    assert exact.mean() < 1.5


def test_query(spark):
    """The registered query over a whole table against its SQL."""
    import duckdb

    from fieldstrata.llm.queries import op11_centroids, oracle_sql

    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.sql(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    df = op11_centroids(spark, sf)
    want = db.sql(oracle_sql()["op11_centroids"])
    names = [c for c in want.columns]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(want.fetchall())
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert got(df) == brute(rows, 8, 10, 64)
