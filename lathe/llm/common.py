"""Column picking and keys of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.session import delete, forget, shared_dir, small_batches, stored

__all__ = ["LAST_ID", "delete", "forget", "numbered", "pick", "position", "shared_dir", "sortable_id", "stored", "table", "text_key"]

#: Sort value of a null id: after every real one.
LAST_ID = (1 << 63) - 1


def numbered(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """The frame with columns renamed to __c0, __c1, ... and the names they had.

    Positions cannot clash, so extra columns of any name (also ones that differ
    from a needed column by case only, or repeat it) do no harm.
    """
    small_batches(df.sparkSession)
    return df.toDF(*[f"__c{k}" for k in range(len(df.columns))]), df.columns


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Exactly these columns; of columns of one name the first, other columns are ignored."""
    renamed, old = numbered(df)
    out = []
    for name in names:
        at = old.index(name) if name in old else [c.lower() for c in old].index(name.lower())
        out.append(F.col(f"__c{at}").alias(name))
    return renamed.select(*out)


def position(names: list[str], name: str) -> int:
    """Index of a column as ``pick`` finds it."""
    return names.index(name) if name in names else [c.lower() for c in names].index(name.lower())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sortable_id(column: Column) -> Column:
    """An id to sort by, nulls last."""
    return F.coalesce(column, F.lit(LAST_ID))


def text_key(column: Column) -> Column:
    """A 64-bit hash of a text; tells rows of one id apart. A null text differs from an empty one."""
    return F.xxhash64(F.coalesce(column, F.lit("\u0000null")))
