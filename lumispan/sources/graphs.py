"""Skeleton graphs in JSON and text files, and the catalog of cloud files."""

from __future__ import annotations

import io
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumispan.functions.store import filesystem

# File names of the form "<series tangle...> <session rest ...> T<threshold>.pcd".
STRUCTURED = r"(?i)^(tangle\w+)\s+(.+?)\s+T([0-9.]+)\.pcd$"


def read_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a graph file.

    Nodes are lists [x, y(, z)], a flat list of triples, or objects with pos or position (else the origin); edges, or links where
    the file has no edges, are lists [i, j] or objects with source and target (else 0). Ids are ordinals.
    """
    text = spark.read.text(path, wholetext=True).select(F.col("value").alias("t"))
    raw = lambda key: F.from_json(F.get_json_object("t", f"$.{key}"), "array<string>")
    numbers = lambda c: F.from_json(c, "array<double>")
    nodes = text.select(F.posexplode(F.coalesce(raw("nodes"), F.array().cast("array<string>"))).alias("i", "n"))
    flat = ~F.trim("n").rlike(r"^[\[{]")
    p = F.when(F.col("n").startswith("["), numbers(F.col("n"))).otherwise(F.coalesce(numbers(F.get_json_object("n", "$.pos")), numbers(F.get_json_object("n", "$.position")), F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))))
    at = lambda k: F.coalesce(F.get("p", F.lit(k)), F.lit(0.0)).cast("float")
    made = nodes.where(~flat).select(F.col("i").cast("long").alias("node_id"), p.alias("p")).select("node_id", at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))
    loose = nodes.where(flat).groupBy(F.floor(F.col("i") / 3).alias("node_id")).agg(*[F.max(F.when(F.col("i") % 3 == k, F.col("n").cast("float"))).alias(c) for k, c in enumerate("xyz")])
    edges = text.select(F.explode(F.coalesce(raw("edges"), raw("links"), F.array().cast("array<string>"))).alias("e"))
    end = lambda k, key: F.when(F.col("e").startswith("["), F.get(numbers(F.col("e")), F.lit(k))).otherwise(F.coalesce(F.get_json_object("e", f"$.{key}").cast("double"), F.lit(0.0))).cast("long")
    return made.unionByName(loose), edges.select(end(0, "source").alias("src"), end(1, "target").alias("dst"))


def write_graph_json(nodes: DataFrame, edges: DataFrame, path: str) -> str:
    """{"nodes": [[x, y, z], ...], "edges": [[i, j], ...]}, written row by row on the driver (the format is one JSON value)."""
    system, place = filesystem(path)
    with io.TextIOWrapper(system.open_output_stream(place), encoding="utf-8") as f:
        f.write('{\n  "nodes": [')
        for i, r in enumerate(nodes.orderBy("node_id").select(*[F.col(c).cast("double").alias(c) for c in "xyz"]).toLocalIterator()):
            f.write(f"{',' * bool(i)}\n    {json.dumps(list(r))}")
        f.write('\n  ],\n  "edges": [')
        for i, r in enumerate(edges.orderBy("src", "dst").select("src", "dst").toLocalIterator()):
            f.write(f"{',' * bool(i)}\n    {json.dumps(list(r))}")
        f.write("\n  ]\n}\n")
    return path


def _lines(spark: SparkSession, path: str, least: int) -> DataFrame:
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("no", "line"))
    return rows.select("no", F.split(F.trim("line"), r"\s+").alias("t")).where((F.size("t") >= least) & (F.get("t", F.lit(0)) != ""))


def read_nodes_text(spark: SparkSession, path: str) -> DataFrame:
    """A node for each line that is not blank; z is 0 where it has two numbers."""
    kept = _lines(spark, path, 2).withColumn("node_id", (F.row_number().over(W.orderBy("no")) - 1).cast("long"))  # the lines of one file
    at = lambda k: F.coalesce(F.get("t", F.lit(k)).try_cast("float"), F.lit(0.0)).cast("float")
    return kept.select("node_id", at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))


def read_edges_text(spark: SparkSession, path: str, marked: bool = False) -> DataFrame:
    """(src, dst) of each line with two numbers at least, or (src, dst, marker) of those with three."""
    names = ["src", "dst", "marker"] if marked else ["src", "dst"]
    return _lines(spark, path, len(names)).select(*[F.get("t", F.lit(k)).try_cast("double").cast("long").alias(n) for k, n in enumerate(names)])


def structured_catalog(files: DataFrame, name: Column) -> DataFrame:
    """series, session, threshold and name of the files with structured names."""
    part = lambda k: F.regexp_extract(name, STRUCTURED, k)
    return files.where(name.rlike(STRUCTURED)).select(part(1).alias("series"), part(2).alias("session"), part(3).alias("threshold"), name.alias("name"))


def ordered_catalog(found: DataFrame) -> DataFrame:
    """By series and session as text, then by threshold as a number (``value``); what is no number comes first."""
    return found.withColumn("value", F.col("threshold").try_cast("double")).orderBy("series", "session", "value", "name")


def convert_recon(spark: SparkSession, nodes_path: str, edges_path: str, path: str) -> str:
    """A graph in JSON from its text files of nodes and edges."""
    return write_graph_json(read_nodes_text(spark, nodes_path), read_edges_text(spark, edges_path), path)


def write_points_text(points: DataFrame, path: str) -> str:
    """A folder of text files with "x y z" of each point, six places each (halves to even), in the order of point_id."""
    ordered = points.repartitionByRange("point_id").sortWithinPartitions("point_id")
    ordered.select(F.format_string("%.6f %.6f %.6f", *[F.bround(F.col(c).cast("double"), 6) for c in "xyz"])).write.mode("overwrite").text(path)
    return path


def flat_catalog(files: DataFrame, name: Column) -> DataFrame:
    return files.where(F.lower(name).endswith(".pcd")).select(F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), name.alias("name"))


def catalog(spark: SparkSession, folder: str) -> tuple[DataFrame, bool]:
    """The cloud files of a folder and whether their names are structured; (empty, False) if there are none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pcd").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"))
    name = F.url_decode("file")
    found = structured_catalog(files, name)
    return (found, True) if not found.isEmpty() else (flat_catalog(files, name), False)


def filter_series(found: DataFrame, text: str) -> DataFrame:
    return found.where(F.lower("series").contains(text.lower()))


def recon_edges(base: DataFrame, good: DataFrame, back: DataFrame) -> DataFrame:
    """Marked edges joined: those of the base with marker -1 or 1, all others under marker 2."""
    rest = good.select("src", "dst").unionByName(back.select("src", "dst")).withColumn("marker", F.lit(2).cast("long"))
    return base.where(F.col("marker").isin(-1, 1)).select("src", "dst", F.col("marker").cast("long").alias("marker")).unionByName(rest)
