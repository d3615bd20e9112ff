"""Files in any store that pyarrow knows, and scratch folders that all executors share."""

from __future__ import annotations

import fnmatch
import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def filesystem(uri: str):
    """(pyarrow file system, path in it) of a URI or a plain path; ValueError for stores that only Spark knows."""
    from pyarrow import fs

    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    if "://" not in uri:
        return fs.LocalFileSystem(), os.path.abspath(uri)
    try:
        return fs.FileSystem.from_uri(uri)
    except (ValueError, OSError) as e:
        raise ValueError(f"no file system for {uri}: {e}") from e


def files(uri: str, pattern: str = "*") -> list[str]:
    """Paths (in their file system) of a file, of the visible files of a folder, or of those that a pattern in the last part names."""
    from pyarrow import fs

    system, path = filesystem(uri)
    folder, _, last = path.rstrip("/").rpartition("/")
    if any(c in last for c in "*?["):
        path, pattern = folder or "/", last
    info = system.get_file_info(path)
    if info.type == fs.FileType.File:
        return [path]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    found = [f.path for f in system.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")) and fnmatch.fnmatch(f.base_name, pattern)]
    return sorted(found)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where driver and executors are one machine (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base
    held = spark.sparkContext.getCheckpointDir()
    if held:
        return held
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="lumispan-")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{uuid.uuid4().hex[:12]}-{name}"
