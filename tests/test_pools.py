"""Training pools, label import and nested evidence on small tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldstrata.operators import pools as P
from fieldstrata.sources import tables

PLOT = "loc_id string, lon double, lat double, block_id string, states map<int,string>, embeddings map<int,array<double>>, changed boolean"


@pytest.fixture(scope="module")
def plots(spark):
    rng = random.Random(1)
    rows = []
    for i in range(12):
        v = {y: [rng.random() for _ in range(3)] for y in (2018, 2019, 2020, 2021)}
        rows.append((f"p{i}", float(i), 0.0, f"b{i % 3}", {y: "a" if i % 4 or y < 2020 else "b" for y in v}, v, i % 4 == 0))
    return spark.createDataFrame(rows, PLOT)


def test_arms(spark, plots):
    ends, stable, pseudo = P.endpoints(plots, 2018, 2021), P.stable_years(plots, 2018, [2019, 2020]), P.pseudo_years(plots, [2019, 2020])
    assert [x.count() for x in (ends, stable, pseudo)] == [24, 18, 6]
    assert {(r.kind, r.state) for r in stable.collect()} == {("assumed", "a")} and {r.state for r in pseudo.collect()} == {None}
    own = {(r.loc_id, r.year): r.features for r in stable.collect()}
    copies = P.stable_copies(plots, 2018, [2019, 2020]).collect()
    first = {r.loc_id: r.embeddings[2018] for r in plots.collect()}
    assert len(copies) == 18 and all(r.features == first[r.loc_id] and r.features != own[r.loc_id, r.year] and r.kind == "synthetic" for r in copies)


def test_jitter(spark, plots):
    """Noise of the years' own deviation by feature, the same again from the same seed."""
    rows = [r for r in plots.collect() if not r.changed]
    stack = np.array([[r.embeddings[y] for y in (2018, 2019, 2020, 2021)] for r in rows])
    spread = P.year_spread(plots, [2018, 2019, 2020, 2021])
    assert plots.limit(1).select(spread.alias("s")).first().s == pytest.approx(stack.std(axis=1).mean(axis=0).tolist())
    noisy = P.stable_copies(plots, 2018, list(range(2019, 2119)), spread, 7)
    first = {r.loc_id: r.embeddings[2018] for r in rows}
    gaps = np.array([np.array(r.features) - first[r.loc_id] for r in noisy.collect()])
    assert np.allclose(gaps.std(axis=0), stack.std(axis=1).mean(axis=0), rtol=0.15) and np.allclose(gaps.mean(axis=0), 0, atol=0.05)
    assert sorted(noisy.collect()) == sorted(P.stable_copies(plots, 2018, list(range(2019, 2119)), spread, 7).collect())


def test_resampled(spark, plots):
    pool = P.external(P.endpoints(plots, 2018, 2021).select("loc_id", "lon", "lat", "block_id", "state", "features").dropDuplicates(["loc_id"]), "other", 2018)
    out = P.footprint_control(pool, plots.filter("block_id = 'b1'").select("block_id"), 3).collect()
    assert len(out) == 4 == len({r.loc_id for r in out}) and {r.block_id for r in out} == {"b1"} and {r.kind for r in out} == {"synthetic"}
    n = spark.createDataFrame([(50,)], "n long")
    more = P.state_control(pool, "a", n, 3).collect()
    assert len(more) == 50 == len({r.loc_id for r in more}) and {r.state for r in more} == {"a"}
    with pytest.raises(Exception, match="no row to resample"):
        P.state_control(pool, "zzz", n, 3).collect()


def test_export(spark, plots):
    out = P.exported(P.endpoints(plots, 2018, 2021).unionByName(P.pseudo_years(plots, [2019])), 3)
    assert out.count() == 24 and out.select("sid").distinct().count() == 24 and out.columns[-3:] == ["f00", "f01", "f02"]
    assert "plots:p3:2018" in {r.sid for r in out.collect()}


def test_label_pools(spark):
    """Fine before coarse, dropped and unmapped classes, null quality; a second source; one point a place."""
    u = spark.createDataFrame([(1, 1, 0, True), (2, 9, 0, True), (3, 9, 1, True), (4, 1, 4, True), (5, None, 1, True), (6, 1, 0, False), (7, 1, 0, None), (8, 9, None, True)], "i int, fine int, coarse int, ok boolean")
    got = P.tagged(u, "fine", "coarse", {1: "crop"}, {0: "built", 1: "trees"}, [4], F.col("ok"), F.lit(True))
    assert {r.i: r.state for r in got.collect()} == {1: "crop", 2: "built", 3: "trees", 5: "trees"}
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0), (3, 1.0, 0.0), (4, 2.0, 0.0)], "id int, lon double, lat double")
    second = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x"), (4, "q")], "id int, lc string")
    t = P.tagged_by_second(points, second, "id", "lc", {"x": "crop", "y": "trees"}, F.col("id") > 0)
    assert {r.id: r.state for r in t.collect()} == {1: "crop", 2: "trees", 3: "crop"}
    assert {r.id for r in P.one_a_place(t, "id").collect()} == {1, 3}


def test_trajectories(spark, plots):
    """Incomplete plots and repeated ones go; the change scalars are those of the endpoints."""
    broken = plots.limit(1).withColumn("loc_id", F.lit("bad")).withColumn("embeddings", F.map_filter("embeddings", lambda k, v: k != 2019))
    out = {r.loc_id: r for r in P.with_trajectories(plots.unionByName(broken).unionByName(plots.filter("loc_id = 'p1'")), [2018, 2019, 2020, 2021]).collect()}
    assert set(out) == {f"p{i}" for i in range(12)}
    for r in plots.collect():
        a, b = (np.array(r.embeddings[y]) for y in (2018, 2021))
        assert out[r.loc_id].l2 == pytest.approx(np.linalg.norm(b - a)) and out[r.loc_id].loo_year in r.embeddings


def test_cleaning(spark):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([1, 1, 1], 300)
    y = rng.integers(0, 3, 300)
    df = spark.createDataFrame([(i, int(y[i]), *map(float, p[i])) for i in range(300)], "i int, y int, a double, b double, c double").repartition(3)
    thr = np.array([p[y == k, k].mean() for k in range(3)])
    pred = p.argmax(1)
    joint = (pred != y) & (p.max(1) >= thr[pred])
    sure = P.confident_flags(df, ["a", "b", "c"], "y")
    assert {r.i: r.flag for r in sure.collect()} == dict(enumerate(joint.tolist()))
    assert {r.i: r.y for r in P.relabelled(sure, "y").collect()} == {i: int(pred[i] if joint[i] else y[i]) for i in range(300)}
    own = p[np.arange(300), y]
    low = own <= np.quantile(own, 0.2)
    assert {r.i for r in P.pruned(P.unsure_flags(df, ["a", "b", "c"], "y", 0.2)).collect()} == set(np.flatnonzero(~low).tolist())


def test_labels_come_back(spark, tmp_path):
    """Quotes, commas, line ends and empty texts through the file; re-sent rows; rows without point; other files refused."""
    rows = [("c", "b1", "1", "e1", 'A, "x"\ny', "2026-10-01 10:00:00", 3.0, "p|q"), ("c", "b1", "1", "e1", "B", "2026-10-02 10:00:00", None, ""), ("c", "b1", "2", "e1", 'say "hi", twice', "2026-10-01 10:00:00", 1.0, None), ("c", "b1", None, "e1", "B", "2026-10-01 10:00:00", 1.0, None), ("c", None, "3", "e1", "B", "2026-10-01 10:00:00", 1.0, None)]
    df = spark.createDataFrame(rows, "campaign string, batch_id string, point_id string, expert_id string, transition string, labelled_at string, confidence double, flags string")
    tables.label_export_csv(df, f"{tmp_path}/out")
    got = {r.point_id: r for r in tables.imported_labels(spark, f"{tmp_path}/out").collect()}
    assert set(got) == {"1", "2"}
    assert got["1"].transition == "B" and got["1"].confidence is None and got["1"].flags == []
    assert got["2"].transition == 'say "hi", twice' and got["2"].confidence == 1.0
    tables.label_export_csv(df.limit(1), f"{tmp_path}/one")
    one = tables.imported_labels(spark, f"{tmp_path}/one").first()
    assert one.transition == 'A, "x"\ny' and one.flags == ["p", "q"]
    df.drop("labelled_at").write.option("header", True).csv(f"{tmp_path}/bad")
    with pytest.raises(ValueError, match="no label file"):
        tables.imported_labels(spark, f"{tmp_path}/bad")


def test_evidence(spark):
    points = spark.createDataFrame([("b", 2, 1.0), ("b", 1, 2.0), ("c", 3, 3.0)], "batch string, id int, lon double")
    values = spark.createDataFrame([(1, "k", 5.0), (1, "j", 6.0), (2, "k", 7.0)], "id int, key string, value double")
    series = spark.createDataFrame([(1, 2020, 0.1), (1, 2018, None)], "id int, year int, ndvi double")
    out = {r.batch: r for r in tables.nested_evidence(points, "batch", "id", values, series, "year").collect()}
    assert [p.id for p in out["b"].points] == [1, 2] and out["b"].points[0].evidence.v == {"k": 5.0, "j": 6.0}
    assert [(t.year, t.ndvi) for t in out["b"].points[0].evidence.t] == [(2018, None), (2020, 0.1)]
    assert out["b"].evidence_schema["keys"] == ["j", "k"] and out["b"].evidence_schema["years"] == [2018, 2020]
    assert out["c"].points[0].evidence.v == {} and out["c"].points[0].evidence.t == []
