"""Leave-location-time-out validation of state classifiers: a training pool, a separate test pool, folds by location."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import metrics as M
from .materialise import kept

#: fit(rows, features, label) gives a function that adds ``prediction`` to rows with the features.
Fit = Callable[[DataFrame, list[str], str], Callable[[DataFrame], DataFrame]]


def nearest_centroid(rows: DataFrame, features: list[str], label: str) -> Callable[[DataFrame], DataFrame]:
    """Predicts the class whose mean features are nearest (ties: the smaller class). The means are a row a class."""
    means = rows.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("c_")).agg(*[F.avg(f).alias(f) for f in features])
    classes = means.agg(F.array_sort(F.collect_list(F.struct("c_", F.array(*features).alias("m")))).alias("classes_"))

    def predict(df: DataFrame) -> DataFrame:
        far = lambda c: sum(((F.col(f) - c["m"][i]) ** 2 for i, f in enumerate(features)), F.lit(0.0))
        best = F.array_min(F.transform("classes_", lambda c: F.struct(F.round(far(c), 9).alias("d"), c["c_"].alias("c"))))["c"]
        return df.crossJoin(F.broadcast(classes)).withColumn("prediction", best).drop("classes_")  # one row

    return predict


def spark_ml(model: str, seed: int = 1) -> Fit:
    """A classifier of ``models.MODELS`` in that form; labels must be 0, 1, ..."""
    from .models import pipeline

    def fit(rows: DataFrame, features: list[str], label: str) -> Callable[[DataFrame], DataFrame]:
        fitted = pipeline(features, model, seed).fit(rows.select(*features, F.col(label).cast("double").alias("label")).dropna())
        return lambda df: fitted.transform(df).select(*df.columns, F.col("prediction").cast("int").alias("prediction"))

    return fit


def mapped(rows: DataFrame, folds: DataFrame, loc: str) -> DataFrame:
    """rows with their location's ``fold``; one that the map has not fails the query, since it could leak."""
    one = folds.select(F.col("loc").alias(loc), F.col("fold"))
    missing = F.raise_error(F.concat(F.lit("location without fold: "), F.coalesce(F.col(loc).cast("string"), F.lit("null")))).cast("int")
    return rows.join(one, loc, "left").withColumn("fold", F.coalesce(F.col("fold").cast("int"), missing))


def leaks(train: DataFrame, test: DataFrame, loc: str, year: str, time_out: bool) -> DataFrame:
    """(locations, years) that training and test rows share; years only count where they must not be shared."""
    where = train.select(loc).distinct().join(test.select(loc).distinct(), loc).agg(F.count("*").alias("locations"))
    when = train.select(year).distinct().join(test.select(year).distinct(), year).agg(F.count("*").alias("years"))
    return where.crossJoin(when).withColumn("years", F.col("years") * int(time_out))  # one row each


def leave_out(
    pool: DataFrame, test: DataFrame, folds: DataFrame, n_folds: int, features: list[str], fit: Fit = nearest_centroid, loc: str = "loc", year: str = "year", state: str = "state", kind: str = "kind",
    test_year: int = 2024, time_out: bool = True,
) -> DataFrame:
    """The scored test rows with ``fold``, ``prediction`` and ``n_train``.

    ``folds`` (loc, fold) is one map for both tables, made from the test table's locations or any other reference, so
    every pool is held out on the same ground. For each fold a model is fitted on the pool's rows of other folds (with
    ``time_out`` also of other years than the test year) and predicts the observed test rows of the fold and test year.
    Rows of kind ``pseudo`` in the pool take part with the state that a first model, fitted on the fold's other training
    rows, gives them. Test rows are never fitted on. A location or year that training and test rows share fails the query.
    Folds without test rows have no result. Both tables meet the map once and are written; the folds read what is written,
    and leaks and counts come from one row a fold, location and year.
    """
    rows, asked = mapped(pool, folds, loc), mapped(test.filter((F.col(kind) == "observed") & (F.col(year) == test_year)), folds, loc)
    if time_out:
        rows = rows.filter(F.col(year) != test_year)
    rows, asked = kept(rows), kept(asked)
    spots, asked_spots = (kept(t.groupBy("fold", loc, year).agg(F.count("*").alias("n_"))) for t in (rows, asked))
    out = None
    for k in range(n_folds):
        train, held = rows.filter(F.col("fold") != k), asked.filter(F.col("fold") == k)
        real, pseudo = train.filter(F.col(kind) != "pseudo"), train.filter(F.col(kind) == "pseudo")
        bridged = fit(real, features, state)(pseudo).withColumn(state, F.col("prediction").cast(dict(pool.dtypes)[state])).drop("prediction")
        whole = real.unionByName(bridged.select(*real.columns))
        spot = spots.filter(F.col("fold") != k)
        shared = leaks(spot, asked_spots.filter(F.col("fold") == k), loc, year, time_out)
        guard = shared.crossJoin(spot.agg(F.coalesce(F.sum("n_"), F.lit(0)).alias("n_train"))).select(F.when((F.col("locations") > 0) | (F.col("years") > 0), F.raise_error("training and test rows share a location or year").cast("long")).otherwise(F.col("n_train")).alias("n_train"))
        part = fit(whole, features, state)(held).crossJoin(F.broadcast(guard))  # one row
        out = part if out is None else out.unionByName(part)
    return out


def reads(scored: DataFrame, state: str = "state", changed: str = "changed") -> DataFrame:
    """(read, n, accuracy, balanced, macro_f1): over all scored rows, those of changed plots, and those of stable ones."""
    which = F.explode(F.array(F.lit("all"), F.when(F.col(changed), "changed").otherwise("stable")))
    conf = kept(scored.withColumn("read", which).groupBy("read", F.col(state).alias("truth"), F.col("prediction").alias("pred")).agg(F.count("*").alias("n")))  # read several times
    return M.overall(conf, ["read"]).join(conf.groupBy("read").agg(F.sum("n").alias("n")), "read")


def fold_rows(scored: DataFrame, state: str = "state") -> DataFrame:
    """(fold, n, n_train, accuracy, balanced, macro_f1) of each fold."""
    conf = scored.groupBy("fold", F.col(state).alias("truth"), F.col("prediction").alias("pred")).agg(F.count("*").alias("n"), F.max("n_train").alias("t_"))
    conf = kept(conf)  # read several times
    return M.overall(conf, ["fold"]).join(conf.groupBy("fold").agg(F.sum("n").alias("n"), F.max("t_").alias("n_train")), "fold")
