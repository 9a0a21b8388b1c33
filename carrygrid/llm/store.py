"""Tables of a running job in the shared folder, and readers of the inputs."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carrygrid.session import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = "8m"


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """The settings hold inside, and are as before after it."""
    before = {key: spark.conf.get(key, None) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def small_batches(spark: SparkSession):  # noqa: ANN201
    """Arrow batches of ``BATCH_BYTES``: each is held twice, by Spark and by its Python worker."""
    return settings(spark, {BATCH: BATCH_BYTES})


def written(spark: SparkSession, df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: it cuts the lineage and outlives executors."""
    path = shared_folder(spark, purpose)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(spark: SparkSession, df: DataFrame) -> None:
    """Remove a table that ``written`` made and that nothing reads any more."""
    jvm = spark._jvm
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def held_out(doc_id):
    """Fold of a document: true where crc32 of the id as text leaves 1 modulo 3; false for null ids."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 3 == 1, F.lit(False))
