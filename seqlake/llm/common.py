"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows in one Arrow batch: documents can be long, so batches are kept short to bound a worker's memory.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows of the Arrow batches that Python workers get."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text; a null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir, or a local one where it is unset and Spark runs locally (tests)."""
    sc = spark.sparkContext
    there = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not there:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        there = "/tmp/seqlake-checkpoints"
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(there)
    return there


def written(df: DataFrame) -> DataFrame:
    """The rows of df from a table in the shared folder: lineage is cut, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/seqlake-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(*dfs: DataFrame) -> None:
    """Delete the files of tables that written() made and nothing reads any longer."""
    for df in dfs:
        spark = df.sparkSession
        for f in df.inputFiles()[:1]:
            jvm = spark._jvm
            path = jvm.org.apache.hadoop.fs.Path(f).getParent()
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files that no DataFrame needs any longer, before the next large step."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_last: list[dict] = []


def sole(models: dict) -> dict:
    """models, which an operator keeps in this worker process; those of the operator that worked here before go."""
    if not _last or _last[0] is not models:
        for others in _last:
            others.clear()
        _last[:] = [models]
        gc.collect()
    return models


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(id_col: str, parts: int, part: int):
    """Whether crc32 of the id as text, modulo parts, is part. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(False))


def arrow(batches: Iterator[pa.RecordBatch], work) -> Iterator[pa.RecordBatch]:
    """work() of each batch that has rows."""
    for b in batches:
        if b.num_rows:
            yield work(b)


def appended(docs: DataFrame, new: list[tuple[str, T.DataType]], source: str, work, after=None) -> DataFrame:
    """docs with columns that work() makes from the source column; columns of the same name are replaced. after() ends a task."""
    names = [n for n, _ in new]
    rest = docs.drop(*[n for n in names if n != source])
    keep = [c for c in rest.columns if c not in names]
    fields = [rest.schema[c] for c in keep] + [T.StructField(n, k) for n, k in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            made = work(b.column(source))
            return pa.RecordBatch.from_arrays([b.column(c) for c in keep] + made, names=keep + names)

        yield from arrow(batches, one)
        if after:
            after()

    small_batches(docs.sparkSession)
    return rest.mapInArrow(run, T.StructType(fields))
