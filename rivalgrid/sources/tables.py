"""Readers of stat tables and writers of outputs."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivalgrid.session import shared_folder

# Common group-name aliases.
GROUP_ALIASES = {"LA": "LAR", "JAC": "JAX", "WSH": "WAS", "OAK": "LV", "SD": "LAC", "STL": "LAR"}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast to a schema: absent numeric columns read as zero, other absent columns as NULL."""
    out = []
    for f in schema.fields:
        if f.name in df.columns:
            out.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            out.append(F.lit(0 if isinstance(f.dataType, T.NumericType) else None).cast(f.dataType).alias(f.name))
    return df.select(*out)


def read_seasons(
    spark: SparkSession, path: str, schema: T.StructType, seasons: Sequence[int], group_columns: Sequence[str] = (),
    aliases: dict[str, str] | None = None, renames: dict[str, str] | None = None
) -> DataFrame:
    """Rows of the wanted seasons under one schema. A table that is not there yet reads as empty.

    The season filter and the column list reach the parquet scan; with season-partitioned folders
    the filter prunes folders.
    """
    try:
        raw = spark.read.parquet(path)
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)
    rows = conform(raw.withColumnsRenamed(renames or {}), schema)
    if "season" in schema.names and seasons:
        rows = rows.where(F.col("season").isin(*seasons))
    return normalize_groups(rows, group_columns, aliases) if group_columns else rows


def in_years(date: str, years: Sequence[int]) -> Column:
    """Date ranges of the years, which reach the scan as filters where ``year(date)`` would not."""
    spans = [(F.col(date) >= F.lit(f"{y}-01-01").cast("date")) & (F.col(date) < F.lit(f"{y + 1}-01-01").cast("date")) for y in years]
    return reduce(or_, spans, F.lit(False))


def normalize_groups(df: DataFrame, columns: Sequence[str], aliases: dict[str, str] | None = None) -> DataFrame:
    """Replace group-name aliases in the listed columns; unknown names stay."""
    return df.replace(aliases or GROUP_ALIASES, subset=list(columns))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the session's cut tables, which every executor can reach."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def write_tenant_tables(df: DataFrame, path: str, tenant: str) -> None:
    """Overwrite only the tenants present in ``df``; the others keep their last output. Rows of a tenant
    are spread over a few files instead of one per task and tenant."""
    spread = df.repartition(tenant, F.pmod(F.xxhash64(*df.columns), F.lit(8)))
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(tenant).parquet(path)


def write_csv(df: DataFrame, path: str, order: Sequence[str]) -> None:
    df.orderBy(*order).write.mode("overwrite").option("header", True).csv(path)


def write_training_table(df: DataFrame, path: str) -> None:
    """Partitioned by season; rows of a season are spread over files instead of one per task and season."""
    df.repartition("season", F.pmod(F.xxhash64(*df.columns), F.lit(8))).write.mode("overwrite").partitionBy("season").parquet(path)
