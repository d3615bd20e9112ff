import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumispan.operators.clouds import cloud
from lumispan.sources import graphs as SG
from lumispan.sources import pcd as SP
from lumispan.sources import records
from lumispan.streaming import session as L


def head(fields, sizes, types, n, data, counts=None):
    return f"# c\nVERSION 0.7\nFIELDS {fields}\nSIZE {sizes}\nTYPE {types}\nCOUNT {counts or ' '.join('1' for _ in fields.split())}\nWIDTH {n}\nHEIGHT 1\nPOINTS {n}\nDATA {data}\n".encode()


def test_ascii(spark, tmp_path):
    (p := tmp_path / "a.pcd").write_bytes(head("x y z", "4 4 4", "F F F", 3, "ascii") + b"1 2 3\n4 5 6\nnan 0 0\n")
    got = SP.read_pcd(spark, str(p)).orderBy("point_id").collect()
    assert [(r.point_id, r.x, r.z) for r in got] == [(0, 1.0, 3.0), (1, 4.0, 6.0)] and abs(got[0].r - 0.7) < 1e-6


def test_split_channels_and_vectors(spark, tmp_path):
    rows = np.array([(1, 2, 3, 255, 0, 51, [0] * 3), (4, 5, 6, 0, 255, 0, [1] * 3)], dtype=[("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("r", "u1"), ("g", "u1"), ("b", "u1"), ("f", "<f4", 3)])
    (p := tmp_path / "b.pcd").write_bytes(head("X Y Z R G B F", "4 4 4 1 1 1 4", "F F F U U U F", 2, "binary", "1 1 1 1 1 1 3") + rows.tobytes())
    got = SP.read_pcd(spark, str(p)).orderBy("point_id").collect()
    assert [round(v, 4) for v in got[0][4:8]] == [1.0, 0.0, 0.2, 1.0] and got[1].x == 4


def test_compressed(spark, tmp_path):
    flat = b"".join(np.array(v, "<f4").tobytes() for v in ([1, 2], [3, 4], [5, 6]))
    packed = bytes([len(flat) - 1]) + flat
    (p := tmp_path / "c.pcd").write_bytes(head("x y z", "4 4 4", "F F F", 2, "binary_compressed") + struct.pack("<II", len(packed), len(flat)) + packed)
    assert [tuple(r)[1:4] for r in SP.read_pcd(spark, str(p)).orderBy("point_id").collect()] == [(1.0, 3.0, 5.0), (2.0, 4.0, 6.0)]
    assert SP.lzf_decompress(b"\x02abc\x20\x02", 6) == b"abcabc"


def test_bad_headers():
    for raw in (head("x y", "4 4", "F F", 1, "ascii"), head("x y z", "4 4 4", "F F F", 1, "zip"), b"FIELDS x\n"):
        with pytest.raises(ValueError):
            SP.parse_header(raw)


def test_round_trips(spark, tmp_path):
    d = cloud(spark.createDataFrame([(i, float(i), 0.5, -1.0, i / 255, 1.0, 0.0) for i in range(256)], "point_id long, x float, y float, z float, r float, g float, b float"))
    back = SP.read_pcd(spark, SP.write_pcd(d, str(tmp_path / "d.pcd"))).orderBy("point_id").collect()
    assert [round(r.r * 255) for r in back] == list(range(256)) and [r.x for r in back] == [float(i) for i in range(256)]
    assert [r.red for r in SP.read_ply(spark, SP.write_ply(d, str(tmp_path / "d.ply"))).orderBy("point_id").collect()] == list(range(256))


def test_ranges_and_folders(spark, tmp_path):
    """A binary file makes a task for each range; each file of a folder has its own header; ids count on."""
    kinds = [("x", "<f4"), ("y", "<f4"), ("z", "<f4")]
    one = np.array([(i, 0, -i) for i in range(1000)], kinds)
    two = np.array([(i, 1, 2, 0xFF0080) for i in range(7)], [*kinds, ("rgb", "<u4")])
    (tmp_path / "a.pcd").write_bytes(head("x y z", "4 4 4", "F F F", 1000, "binary") + one.tobytes())
    (tmp_path / "b.pcd").write_bytes(head("x y z rgb", "4 4 4 4", "F F F U", 7, "binary") + two.tobytes())
    (tmp_path / "c.pcd").write_bytes(head("x y z", "4 4 4", "F F F", 2, "ascii") + b" 1  2 3 \r\n\r\n4 oops 6\n7 8 9\n")
    (tmp_path / "_hidden.pcd").write_bytes(b"no header")
    (tmp_path / "notes.txt").write_bytes(b"nor here")
    part = SP.read_pcd(spark, str(tmp_path / "a.pcd"), rows=64)
    assert part.rdd.getNumPartitions() == 16 and [(r.point_id, r.x, r.z) for r in part.orderBy("point_id").collect()] == [(i, float(i), float(-i)) for i in range(1000)]
    whole = SP.read_pcd(spark, f"file://{tmp_path}", rows=300).orderBy("point_id").collect()
    assert [r.point_id for r in whole] == [*range(1000), *range(1000, 1007), 1007]
    assert abs(whole[1003].b - 128 / 255) < 1e-6 and whole[1003].g == 0 and (whole[1007].x, whole[1007].z) == (1.0, 3.0)
    assert SP.read_pcd(spark, str(tmp_path / "[ab].pcd")).count() == 1007
    (tmp_path / "none").mkdir()
    assert SP.read_pcd(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="fewer records"):
        (tmp_path / "d.pcd").write_bytes(head("x y z", "4 4 4", "F F F", 9, "binary") + one[:8].tobytes())
        SP.read_pcd(spark, str(tmp_path / "d.pcd")).collect()
    with pytest.raises(Exception, match="fewer lines"):
        (tmp_path / "e.pcd").write_bytes(head("x y z", "4 4 4", "F F F", 2, "ascii") + b"1 2 3\n")
        SP.read_pcd(spark, str(tmp_path / "e.pcd")).collect()


def test_a_large_sparse_file(spark, tmp_path):
    """Over 2 GB, which no task reads whole; the file has a hole, and the tasks of a range alone are run."""
    n = 200_000_000
    raw = head("x y z", "4 4 4", "F F F", n, "binary")
    with open(tmp_path / "big.pcd", "wb") as f:
        f.write(raw)
        f.seek(len(raw) + 12 * (n - 1))
        f.write(np.array([1.5, 2.5, 3.5], "<f4").tobytes())
    parts = records.Reader("pcd", {"path": str(tmp_path / "big.pcd")}, ["x", "y", "z"])
    ranges = parts.partitions()
    assert len(ranges) == -(-n // records.ROWS) and max(r.last - r.first for r in ranges) == records.ROWS
    last = list(parts.read(ranges[-1]))[-1]
    assert last.column("point_id")[-1].as_py() == n - 1 and last.column("z")[-1].as_py() == 3.5


def test_writer_commits(spark, tmp_path):
    """Folders take files that tasks wrote whole; what a failed job wrote is gone; overwriting removes what was there."""
    d = cloud(spark.createDataFrame([(i, float(i), 0.5, -1.0, i / 255, 1.0, 0.0) for i in range(256)], "point_id long, x float, y float, z float, r float, g float, b float"))
    path = tmp_path / "cloud"
    SP.write_pcd(d.repartition(4), str(path), single=False)
    first = sorted(p.name for p in path.iterdir())
    assert SP.read_pcd(spark, str(path)).count() == 256 and all(n.endswith(".pcd") for n in first)
    SP.write_pcd(d.where("point_id < 100"), str(path), single=False)
    assert SP.read_pcd(spark, str(path)).count() == 100 and not set(first) & {p.name for p in path.iterdir()}
    rows = d.select("x", "y", "z", F.lit(0).alias("rgb"))
    rows.write.format("pcd").mode("append").option("rows", 30).save(str(path))
    assert SP.read_pcd(spark, str(path)).count() == 356
    bad = rows.withColumn("x", F.when(F.col("x") > 200, F.raise_error(F.lit("stop"))).otherwise(F.col("x")).cast("float"))
    before = sorted(p.name for p in path.iterdir())
    with pytest.raises(Exception, match="stop"):
        bad.write.format("pcd").mode("append").save(str(path))
    assert sorted(p.name for p in path.iterdir()) == before
    with pytest.raises(Exception, match="rgb"):
        rows.drop("rgb").write.format("pcd").mode("append").save(str(path))
    empty = SP.write_ply(d.limit(0), str(tmp_path / "empty.ply"))
    assert SP.read_ply(spark, empty).count() == 0 and sorted(p.name for p in tmp_path.iterdir()) == ["cloud", "empty.ply"]


def test_graph_json(spark, tmp_path):
    cases = [({"nodes": [[0, 0], [1, 1]], "links": [{"source": 0, "target": 1}]}, [(0.0, 0.0, 0.0), (1.0, 1.0, 0.0)], [(0, 1)]), ({"nodes": [{"id": 7, "pos": [1, 2, 3]}, {"position": [4, 5, 6]}, {}], "edges": [], "links": [[0, 1]]}, [(1.0, 2.0, 3.0), (4.0, 5.0, 6.0), (0.0, 0.0, 0.0)], []), ({"nodes": [0, 1, 2, 3, 4, 5], "edges": [[0, 1]]}, [(0.0, 1.0, 2.0), (3.0, 4.0, 5.0)], [(0, 1)])]
    for i, (content, nodes, edges) in enumerate(cases):
        (p := tmp_path / f"g{i}.json").write_text(json.dumps(content))
        n, e = SG.read_graph_json(spark, str(p))
        assert [tuple(r)[1:] for r in n.orderBy("node_id").collect()] == nodes
        assert [tuple(r) for r in e.collect()] == edges


def test_text_and_catalog(spark, tmp_path):
    (tmp_path / "n.txt").write_text("0 1\n\n2 3 4\n")
    (tmp_path / "e.txt").write_text("0 1 -1\n1\n1 0 0\n")
    assert [tuple(r) for r in SG.read_nodes_text(spark, str(tmp_path / "n.txt")).orderBy("node_id").collect()] == [(0, 0.0, 1.0, 0.0), (1, 2.0, 3.0, 4.0)]
    assert [tuple(r) for r in SG.read_edges_text(spark, str(tmp_path / "e.txt"), marked=True).collect()] == [(0, 1, -1), (1, 0, 0)]
    (tmp_path / "tangle01 p1 2024 T0.5.pcd").write_text("x")
    found, structured = SG.catalog(spark, str(tmp_path))
    assert structured and [tuple(r)[:3] for r in found.collect()] == [("tangle01", "p1 2024", "0.5")]


def test_session(spark):
    d = spark.createDataFrame([(1, True, True)], "point_id long, alive boolean, selected boolean")
    s = L.Session(cloud=d)
    s.edit("cloud", lambda x: x.selectExpr("point_id", "false AS alive", "false AS selected"), L.keep_unselected)
    assert s.undo() and s.tables["cloud"].first()[:] == (1, True, False)
    assert s.redo() and s.tables["cloud"].first().alive is False
    for _ in range(21):
        s.edit("cloud", lambda x: x)
    assert sum(s.undo() for _ in range(30)) == 20


def test_replay(spark):
    log = spark.createDataFrame([(1, i, "edit") for i in range(21)] + [(1, 50 + i, "undo") for i in range(25)] + [(1, 90, "redo")], "log_id long, seq long, kind string")
    assert L.replay(log).first()[:] == (1, 2, 19)
