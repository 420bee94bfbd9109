"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.materialise import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there, so lost executors cost no recomputation."""
    path = path or f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def narrow(df: DataFrame, rows: int) -> DataFrame:
    """df, which comes from a shuffle and has about ``rows`` short rows, in one task for each 100,000 and one a core at
    least: as many tasks as a large table's shuffles have would be files and task reports without rows."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, rows // 100_000))


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs staged with a number for each row, and the number's column: what tells rows of one doc_id apart. The numbers
    are fixed once written; the column's name is none of docs' own."""
    name = "row_"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return staged(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def unstage(*frames: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in frames:
        path = getattr(df, "staged_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def rows_of(batches: Iterator[pa.RecordBatch], chars: int = 8_000_000, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches so that none holds much more than that many bytes of text (a single row may)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = batch.column(batch.schema.get_field_index(text)).nbytes
        step = max(1, int(batch.num_rows * min(1.0, chars / max(size, 1))))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Texts of a batch; null is empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def doc_columns(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that others (whatever their names) cannot clash; a column that is absent is null."""
    have = set(docs.columns)
    kinds = {"doc_id": "bigint", "text": "string", "source": "string", "lang": "string", "n_chars": "bigint"}
    return docs.select(*[F.col(n).cast(kinds.get(n, "string")).alias(n) if n in have else F.lit(None).cast(kinds.get(n, "string")).alias(n) for n in names])
