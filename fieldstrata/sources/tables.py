"""Readers and writers of survey files: sharded areas, GeoJSON, label exports, batches, manifests and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LABELS = "campaign string, batch_id string, point_id string, expert_id string, transition string, labelled_at timestamp"


def area_shards(spark: SparkSession, path: str, lookup: DataFrame) -> DataFrame:
    """km2 per stratum from many CSV files of (stratum id, m2); blank fields are skipped, a byte-order mark too.

    lookup: (id, stratum). An id that it lacks raises when the plan runs. Strata without area are left out.
    """
    raw = spark.read.option("header", True).csv(path)
    raw = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    a = raw.select(F.expr("try_cast(trim(stratum) as int)").alias("id"), F.expr("try_cast(trim(area) as double)").alias("m2")).dropna()
    s = a.groupBy("id").agg((F.sum("m2") / 1e6).alias("area")).join(lookup, "id", "left")
    name = F.when(F.col("stratum").isNull(), F.raise_error(F.concat(F.lit("unknown stratum id: "), F.col("id").cast("string"))).cast("string")).otherwise(F.col("stratum"))
    return s.select(name.alias("stratum"), "area").filter("area > 0")


def cell_areas(spark: SparkSession, path: str) -> DataFrame:
    """(cell, m2): the cell code of each row, or of the file's name where the row has none."""
    raw = spark.read.option("header", True).csv(path).withColumn("file_", F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1))
    return raw.select(F.coalesce(F.expr("nullif(trim(cell), '')"), F.col("file_")).alias("cell"), F.expr("try_cast(area as double)").alias("m2")).groupBy("cell").agg(F.sum("m2").alias("m2"))


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """A row of properties for each feature, with lon and lat of points."""
    f = spark.read.option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    return f.select("f.properties.*", F.col("f.geometry.coordinates")[0].alias("lon"), F.col("f.geometry.coordinates")[1].alias("lat"))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """By the file's suffix."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind in ("csv", "tsv"):
        return spark.read.option("header", True).option("sep", "\t" if kind == "tsv" else ",").option("multiLine", True).option("escape", '"').csv(path)
    if kind == "geojson":
        return geojson(spark, path)
    if kind == "json":
        return spark.read.option("multiLine", True).json(path)
    raise ValueError(f"unknown kind of file: {path}")


def label_export(spark: SparkSession, *paths: str) -> DataFrame:
    """Label rows, all text but the time; a file whose first column is not campaign (an error page, say) is refused."""
    out = None
    for p in paths:
        raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(p)
        if raw.columns[0].lstrip("﻿") != "campaign":
            raise ValueError(f"not a label export: {p}")
        out = raw if out is None else out.unionByName(raw, allowMissingColumns=True)
    return out.withColumn("labelled_at", F.expr("try_cast(labelled_at as timestamp)"))


def write_batches(df: DataFrame, path: str) -> None:
    """One JSON row per batch: a header and its points in rank order, in folders by batch."""
    points = F.sort_array(F.collect_list(F.struct("rank", *[c for c in df.columns if c not in ("batch_id", "rank")]))).alias("points")
    df.groupBy("batch_id").agg(F.count("*").alias("n"), points).write.mode("overwrite").partitionBy("batch_id").json(path)


def merged_manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    """New batches replace old ones of the same id; calibration first, then teaching, then qualifying, then by age."""
    m = old.join(new.select("batch_id"), "batch_id", "left_anti").unionByName(new, allowMissingColumns=True)
    order = F.when(F.col("calibration"), 0).when(F.col("stage") == "teach", 1).when(F.col("stage") == "qualify", 2).otherwise(3)
    return m.withColumn("order_", order).orderBy("order_", "build_seq").drop("order_")


def append_ledger(rows: DataFrame, path: str) -> None:
    """Append rows to a ledger: missing columns are null, unknown columns are refused."""
    spark = rows.sparkSession
    have = spark.read.parquet(path).schema
    extra = set(rows.columns) - set(have.names)
    if extra:
        raise ValueError(f"columns that the ledger lacks: {sorted(extra)}")
    rows.select(*[F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in have]).write.mode("append").parquet(path)


def merge_keyed(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace rows with the same keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def legend(spark: SparkSession, path: str) -> DataFrame:
    """(code, label) of a style file: value="..." and label="..." in either order."""
    line = spark.read.text(path)
    tags = line.select(F.explode(F.regexp_extract_all("value", F.lit(r"(<[^>]*value=[^>]*>)"), F.lit(1))).alias("tag"))
    return tags.select(F.regexp_extract("tag", r'\bvalue="(\d+)"', 1).cast("int").alias("code"), F.regexp_extract("tag", r'\blabel="([^"]*)"', 1).alias("label")).filter("code is not null and label <> ''").distinct()


def cached_areas(spark: SparkSession, path: str, cache: str) -> DataFrame:
    """(id, m2) per stratum id from CSV shards of (stratum, area); written to ``cache`` once and read from there afterwards.

    Blank fields are skipped, strata without area left out.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at):
        raw = spark.read.option("header", True).csv(path)
        raw = raw.toDF(*[c.lstrip("\ufeff").strip() for c in raw.columns])
        a = raw.select(F.expr("try_cast(try_cast(trim(stratum) as double) as int)").alias("id"), F.expr("try_cast(trim(area) as double)").alias("m2")).dropna()
        a.groupBy("id").agg(F.sum("m2").alias("m2")).filter("m2 > 0").write.option("header", True).csv(cache)
    return spark.read.schema("id int, m2 double").option("header", True).csv(cache)


#: Names that a point's columns may have, by preference; columns of other names go to ``meta``.
POINT_NAMES = {"id": ["id", "point_id", "plot_id", "cell_id"], "lon": ["lon", "longitude", "x"], "lat": ["lat", "latitude", "y"]}
POINT_TEXT = ["channel", "prior", "conformal_set", "primary_expert", "reference"]


def normalised_points(raw: DataFrame, batch: str, order: str) -> DataFrame:
    """Points of one batch as (id, lon, lat, channel, ..., rank, score, cell_km, meta), whatever names their file used.

    A point without id is named by the batch and its place in the order, from 0; rank is the place from 1 where it is
    blank or no number, cell_km then 5, score null. Points without finite coordinates go. Null unknown fields are not kept.
    """
    from ..operators.windows import numbered

    have = [c for c in raw.columns if c != order]
    first = lambda names: F.coalesce(*[F.col(c).cast("string") for c in names if c in have], F.lit(None).cast("string"))
    number = lambda c: F.when(~F.isnan(F.expr(f"try_cast({c} as double)")) & (F.abs(F.expr(f"try_cast({c} as double)")) < float("inf")), F.expr(f"try_cast({c} as double)"))
    given = lambda c: number(c) if c in have else F.lit(None).cast("double")
    known = {c for names in POINT_NAMES.values() for c in names} | set(POINT_TEXT) | {"rank", "score", "cell_km"}
    rest = [c for c in have if c not in known]
    pairs = F.filter(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in rest]), lambda e: e["value"].isNotNull()) if rest else None
    meta = F.map_from_entries(pairs) if rest else F.create_map().cast("map<string,string>")
    place = F.col("place_") - 1
    named = F.concat(F.lit(batch + "_"), F.lpad(place.cast("string"), 4, "0"))
    named = F.when(place < 10000, named).otherwise(F.concat(F.lit(batch + "_"), place.cast("string")))
    p = numbered(raw, [F.col(order)], "place_").withColumns({"lon_": first(POINT_NAMES["lon"]), "lat_": first(POINT_NAMES["lat"])})
    out = p.select(
        F.coalesce(first(POINT_NAMES["id"]), named).alias("id"), number("lon_").alias("lon"), number("lat_").alias("lat"), *[first([c]).alias(c) for c in POINT_TEXT],
        F.coalesce(given("rank"), F.col("place_").cast("double")).alias("rank"), given("score").alias("score"), F.coalesce(given("cell_km"), F.lit(5.0)).alias("cell_km"), meta.alias("meta"),
    )
    return out.filter("lon is not null and lat is not null")


def migrated(ledger: DataFrame, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """The ledger with those columns (name: type, default) where it lacks them; a default of None stays null, never 0."""
    return ledger.select("*", *[F.lit(default).cast(kind).alias(name) for name, (kind, default) in columns.items() if name not in ledger.columns])


def label_export_csv(rows: DataFrame, path: str) -> None:
    """Labels as CSV with a header; fields with commas, quotes or line ends are quoted, quotes inside are doubled."""
    rows.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_result(rows: DataFrame, path: str, kind: str) -> None:
    """A result table as csv (with header), json or parquet; fractions keep all their digits."""
    if kind not in ("csv", "json", "parquet"):
        raise ValueError(f"unknown kind of file: {kind}")
    rows.write.mode("overwrite").option("header", True).format(kind).save(path)


#: Columns of which a label file must have point_id and labelled_at and at least one other.
LABEL_MARKS = ("transition", "confidence", "is_change", "flags", "seconds_on_point")
NUMBERS = ("confidence", "is_change", "rank", "score", "lon", "lat", "seconds_on_point")


def imported_labels(spark: SparkSession, path: str, order: str = "labelled_at") -> DataFrame:
    """Rows of an exported label file, typed again: numbers as double, flags as a list, labelled_at as a time.

    A file that does not look like labels is refused. Rows without point or batch are left out, and of rows with the same
    campaign, batch, point and expert the last by ``order`` stays, as if they had been sent again one by one.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    have = set(raw.columns)
    if not {"point_id", "labelled_at"} <= have or not have & set(LABEL_MARKS):
        raise ValueError(f"no label file: {path}")
    typed = {c: F.expr(f"try_cast(nullif({c}, '') as double)") for c in NUMBERS if c in have}
    typed["labelled_at"] = F.expr("try_cast(labelled_at as timestamp)")
    if "flags" in have:
        typed["flags"] = F.filter(F.transform(F.split(F.coalesce("flags", F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    keys = [c for c in ("campaign", "batch_id", "point_id", "expert_id") if c in have]
    rows = raw.withColumn("order_", F.expr(f"try_cast({order} as double)") if order in have and order != "labelled_at" else F.expr("unix_micros(try_cast(labelled_at as timestamp))").cast("double"))
    rows = rows.withColumns(typed).filter(F.coalesce("point_id", F.lit("")) != "")
    rows = rows.filter(F.coalesce("batch_id", F.lit("")) != "") if "batch_id" in have else rows
    rest = [c for c in raw.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("order_", F.xxhash64(*rest))).alias("r_")).select(*keys, "r_.*")


def nested_evidence(points: DataFrame, batch: str, ident: str, values: DataFrame, series: DataFrame, time: str) -> DataFrame:
    """One row a batch: its points, each with evidence (v: a map from key to value, t: its series in time order), and the
    batch's schema, written once: the value keys that occur and the series' years.

    ``values`` has ident, key and value (the last by key of equal keys), ``series`` ident, time and numbers. Points without
    evidence have an empty map and list.
    """
    numbers = [c for c in series.columns if c not in (ident, time)]
    v = values.groupBy(ident, "key").agg(F.max("value").alias("value")).groupBy(ident).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("v"))
    t = series.groupBy(ident).agg(F.sort_array(F.collect_list(F.struct(time, *numbers))).alias("t"))
    joined = points.join(v, ident, "left").join(t, ident, "left")
    filled = F.struct(F.coalesce("v", F.map_from_entries(F.array().cast(f"array<struct<key:{dict(values.dtypes)['key']},value:{dict(values.dtypes)['value']}>>"))).alias("v"), F.coalesce("t", F.array().cast(dict(t.dtypes)["t"])).alias("t"))
    rest = [c for c in points.columns if c not in (batch, ident)]
    out = joined.withColumn("evidence", filled)
    keys = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.map_keys("evidence.v")))))
    years = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform("evidence.t", lambda x: x[time])))))
    by_id = lambda a, b: F.when(a[ident] < b[ident], -1).when(a[ident] > b[ident], 1).otherwise(0)
    return out.groupBy(batch).agg(F.array_sort(F.collect_list(F.struct(ident, *rest, "evidence")), by_id).alias("points"), F.struct(keys.alias("keys"), years.alias("years")).alias("evidence_schema"))  # a batch is small
