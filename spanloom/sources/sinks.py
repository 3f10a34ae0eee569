"""Sinks: layers to Parquet with well-known binary geometry, reports to CSV and Markdown, caches by appending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

import pandas as pd
import struct


@F.pandas_udf(BinaryType())
def _line_bytes(lines: pd.Series) -> pd.Series:
    def one(points) -> bytes | None:
        if points is None:
            return None
        flat = [v for p in points for v in (p["x"], p["y"])]
        return struct.pack(f"<BII{len(flat)}d", 1, 2, len(flat) // 2, *flat)

    return lines.map(one)


@F.pandas_udf(BinaryType())
def _point_bytes(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series([struct.pack("<BIdd", 1, 1, a, b) if pd.notna(a) and pd.notna(b) else None for a, b in zip(x, y, strict=True)], dtype=object)


def point_wkb(x: Column, y: Column) -> Column:
    return _point_bytes(x, y)


def line_wkb(line: Column) -> Column:
    return _line_bytes(line)


def write_layer(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Parquet, with column geom added for points (x, y) or lines (line)."""
    if {"x", "y"} <= set(df.columns):
        df = df.withColumn("geom", point_wkb(F.col("x"), F.col("y")))
    elif "line" in df.columns:
        df = df.withColumn("geom", line_wkb(F.col("line")))
    df.write.mode(mode).parquet(path)
    return path


def write_plan(layers: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """All layers under their names in a folder; what was written."""
    return {name: write_layer(df, f"{folder.rstrip('/')}/{name}") for name, df in layers.items()}


def write_csv(df: DataFrame, path: str) -> str:
    """One CSV file with a header, for reports of bounded size."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)
    return path


def append_cache(df: DataFrame, path: str) -> str:
    """Appends geocoding results (key, lon, lat, raw, q), failures included, as JSON lines."""
    df.write.mode("append").option("ignoreNullFields", "false").json(path)
    return path
