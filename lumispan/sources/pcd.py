"""PCD and PLY clouds by the data sources of :mod:`lumispan.sources.records`.

A store that pyarrow does not know, and Spark does, is read by Spark's binaryFile reader, one task a file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumispan.functions.store import filesystem
from lumispan.functions.vectors import finite, pack_rgb, unpack_rgb, xyz
from lumispan.operators.clouds import cloud
from lumispan.sources import formats, records
from lumispan.sources.formats import lzf_decompress, parse_header  # noqa: F401  part of this module's interface


def _raw(spark: SparkSession, path: str, kind: str, rows: int) -> DataFrame:
    try:
        filesystem(path)
    except ValueError:
        return _through_spark(spark, path, kind)
    spark.dataSource.register(records.PcdSource if kind == "pcd" else records.PlySource)
    return spark.read.format(kind).option("rows", rows).load(path)


def _through_spark(spark: SparkSession, path: str, kind: str) -> DataFrame:
    import pyarrow as pa

    content = spark.read.format("binaryFile").load(path).select("content")
    head = content.select(F.substring("content", 1, 1 << 16)).first()
    if head is None:
        raise FileNotFoundError(path)
    header = formats.read_header(pa.BufferReader(bytes(head[0])), kind)
    schema = formats.schema([header], kind)
    fields = [c.split()[0] for c in schema.split(", ")][1:]

    def decode(batches):
        for batch in batches:
            for c in batch.column(0):
                yield from records.from_bytes(c.as_py(), kind, fields)

    return content.mapInArrow(decode, schema)


def read_pcd(spark: SparkSession, path: str, rows: int = records.ROWS) -> DataFrame:
    """The cloud in a PCD file, folder or pattern: point_id (the ordinal), x, y, z, r, g, b, a, alive, selected.

    A task reads ``rows`` binary records. Points with a coordinate that is not finite go.
    """
    raw = _raw(spark, path, "pcd", rows)
    return _colored(raw.where(finite(*xyz())), raw.columns)


def _colored(raw: DataFrame, fields: list[str]) -> DataFrame:
    if "rgba" in fields or "rgb" in fields:
        name = "rgba" if "rgba" in fields else "rgb"
        parts = unpack_rgb(F.col(name), alpha=name == "rgba")
        raw = raw.withColumns(dict(zip(["__r", "__g", "__b", "__a"], parts, strict=True))).drop("rgb", "rgba", "r", "g", "b")
        raw = raw.withColumnsRenamed({"__r": "r", "__g": "g", "__b": "b", "__a": "a"})
    elif {"r", "g", "b"} <= set(fields):
        top = raw.agg(F.max("r").alias("__top"))
        scale = F.when(F.col("__top") > 1, 255.0).otherwise(1.0)
        raw = raw.join(F.broadcast(top)).withColumns({c: F.col(c) / scale for c in "rgb"}).drop("__top")  # one row
    else:
        raw = raw.drop("r", "g", "b")
    out = cloud(raw)
    return out.select("point_id", "x", "y", "z", *[F.col(c).cast("float").alias(c) for c in "rgba"], "alive", "selected")


def _save(rows: DataFrame, path: str, kind: str, single: bool) -> str:
    rows.sparkSession.dataSource.register(records.PcdSource if kind == "pcd" else records.PlySource)
    ordered = rows.repartitionByRange("point_id").sortWithinPartitions("point_id").drop("point_id")
    ordered.write.format(kind).mode("overwrite").option("single", str(single).lower()).save(path)
    return path


def write_pcd(points: DataFrame, path: str, single: bool = True) -> str:
    """Living points as x, y, z and packed rgb, truncated and not clipped; alpha is not kept. One file, or a folder of files."""
    rows = points.where("alive").select("point_id", "x", "y", "z", pack_rgb(F.col("r"), F.col("g"), F.col("b")).alias("rgb"))
    return _save(rows, path, "pcd", single)


def write_ply(points: DataFrame, path: str, single: bool = True) -> str:
    """Living points as little-endian binary PLY, colours clipped to bytes. One file, or a folder of files."""
    channel = lambda c: (F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c).cast("double"))) * 255).cast("int")
    rows = points.where("alive").select("point_id", "x", "y", "z", channel("r").alias("red"), channel("g").alias("green"), channel("b").alias("blue"))
    return _save(rows, path, "ply", single)


def read_ply(spark: SparkSession, path: str, rows: int = records.ROWS) -> DataFrame:
    """point_id, x, y, z, red, green, blue of files as :func:`write_ply` makes them."""
    return _raw(spark, path, "ply", rows)
