"""Upserts into a stored table, of which only the touched partitions are written again.

Rows lie in folders by a hash of their keys. A delta is merged with the folders of its own keys, and
dynamic overwrite replaces these and leaves all others as they are. The merged rows are written beside
the table first, so a job that dies before the replacement changes nothing; one that dies while folders
are being replaced leaves the merged rows in the shared folder, from which they have to be put back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from fraudloom.operators.merge import upsert_table
from fraudloom.session import materialize

#: Folder of a row; a column of the stored table only.
PART = "key_part"


def _part(keys: list[str], partitions: int) -> Column:
    """A row's folder. Equal keys of equal types meet, NULL keys too."""
    return F.pmod(F.xxhash64(*keys), F.lit(partitions)).cast("int").alias(PART)


def _store(df: DataFrame, path: str, mode: str) -> None:
    (df.hint("rebalance", PART).write.mode(mode).option("partitionOverwriteMode", "dynamic")
     .partitionBy(PART).parquet(path))


def create_keyed(df: DataFrame, path: str, keys: list[str], partitions: int = 256) -> None:
    """Writes a new keyed table. `partitions` is fixed for its lifetime: about the table's size
    over the size that one delta may rewrite for a single key, commonly a few hundred megabytes."""
    _store(df.select("*", _part(keys, partitions)), path, "errorifexists")


def read_keyed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of a keyed table."""
    return spark.read.schema(StructType([*schema.fields]).add(PART, "integer")).parquet(path).drop(PART)


def touched_partitions(delta: DataFrame, keys: list[str], partitions: int = 256) -> list[int]:
    """Folders that a delta reaches, at most `partitions` numbers."""
    return sorted(row[0] for row in delta.select(_part(keys, partitions)).distinct().collect())


def upsert_keyed(
    delta: DataFrame, path: str, schema: StructType, keys: list[str],
    update_cols: list[str] | None = None, partitions: int = 256,
) -> list[int]:
    """Merges `delta` into the table at `path` in place, by the rules of `upsert_table`.

    `schema` is the table's; `delta` may lack columns that are no keys. Its key columns are cast to
    the table's types before they are hashed. Returns the folders that were written again; an empty
    delta writes none. One writer at a time. `delta` is read several times: write an expensive one first.
    """
    spark = delta.sparkSession
    typed = delta.select(*[F.col(name).cast(schema[name].dataType).alias(name)
                           for name in schema.names if name in delta.columns])
    touched = touched_partitions(typed, keys, partitions)
    if not touched:
        return []
    stored = spark.read.schema(StructType([*schema.fields]).add(PART, "integer")).parquet(path)
    old = stored.where(F.col(PART).isin(touched)).drop(PART)
    merged = upsert_table(old, typed, keys, update_cols)
    _store(materialize(merged, "upsert").select("*", _part(keys, partitions)), path, "overwrite")
    return touched
