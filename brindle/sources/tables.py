"""Reading and writing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "data_messages timestamped_values tablet_watermarks file_metas file_entries "
    "descriptor_metas table_descriptors source_weights name_parts"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a folder; a file or a folder of part files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> None:
    """Makes the tables of a folder known to ``spark.sql`` as temporary views."""
    for name in names or TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def read_files(spark: SparkSession, path: str, kind: str = "parquet", schema: T.StructType | str | None = None, **options) -> DataFrame:
    """A file scan of any format Spark brings: parquet, orc, csv, json, text, binaryFile."""
    reader = spark.read.options(**options)
    return (reader.schema(schema) if schema else reader).format(kind).load(path)


def write_files(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", partition_by: list[str] | None = None, **options) -> None:
    """A file sink; ``partition_by`` gives partition folders that later scans prune."""
    writer = df.write.format(kind).mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
