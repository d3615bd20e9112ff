"""Headers, record layouts and decoding of PCD (ascii, binary, compressed) and binary PLY clouds."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Numpy and Spark types of PCD's (TYPE, SIZE).
TYPES = {
    ("F", 4): ("<f4", "float"), ("F", 8): ("<f8", "double"),
    ("I", 1): ("<i1", "tinyint"), ("I", 2): ("<i2", "smallint"), ("I", 4): ("<i4", "int"), ("I", 8): ("<i8", "bigint"),
    ("U", 1): ("<u1", "smallint"), ("U", 2): ("<u2", "int"), ("U", 4): ("<u4", "bigint"), ("U", 8): ("<u8", "decimal(20,0)"),
}


def parse_header(raw: bytes) -> dict:
    """Fields, types, counts, number of points, kind of data and the place where they begin; ValueError if it is no PCD header."""
    found, at = {}, 0
    while True:
        end = raw.find(b"\n", at)
        if end < 0:
            raise ValueError("PCD header without DATA")
        line = raw[at:end].decode("ascii", "replace").strip()
        at = end + 1
        if not line or line.startswith("#"):
            continue
        key, _, rest = line.partition(" ")
        found[key.upper()] = rest.split()
        if key.upper() == "DATA":
            break
    fields = [f.lower() for f in found["FIELDS"]]
    counts = [int(c) for c in found.get("COUNT", ["1"] * len(fields))]
    kinds = list(zip([t.upper() for t in found["TYPE"]], map(int, found["SIZE"]), strict=True))
    for k in kinds:
        if k not in TYPES:
            raise ValueError(f"PCD type {k[0]}{k[1]}")
    points = int(found["POINTS"][0]) if "POINTS" in found else int(found["WIDTH"][0]) * int(found.get("HEIGHT", ["1"])[0])
    data = found["DATA"][0].lower()
    if data not in ("ascii", "binary", "binary_compressed"):
        raise ValueError(f"PCD data {data}")
    if not {"x", "y", "z"} <= set(fields):
        raise ValueError("PCD without x, y and z")
    return {"fields": fields, "kinds": kinds, "counts": counts, "points": points, "data": data, "start": at}


def lzf_decompress(raw: bytes, size: int) -> bytes:
    """Expand an LZF block: control bytes below 32 lead literals, others a length and a distance back."""
    out, i = bytearray(), 0
    while i < len(raw):
        control = raw[i]
        i += 1
        if control < 32:
            out += raw[i : i + control + 1]
            i += control + 1
            continue
        length = control >> 5
        if length == 7:
            length += raw[i]
            i += 1
        back = len(out) - ((control & 31) << 8 | raw[i]) - 1
        i += 1
        if back < 0:
            raise ValueError("broken LZF block")
        for k in range(length + 2):
            out.append(out[back + k])
    if len(out) != size:
        raise ValueError("broken LZF block")
    return bytes(out)


# The layout of records as they are written.
RECORDS = {
    "pcd": np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("rgb", "<i4")]),
    "ply": np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("red", "u1"), ("green", "u1"), ("blue", "u1")]),
}


def header_of(kind: str, n: int) -> bytes:
    if kind == "pcd":
        return f"# .PCD v0.7\nVERSION 0.7\nFIELDS x y z rgb\nSIZE 4 4 4 4\nTYPE F F F F\nCOUNT 1 1 1 1\nWIDTH {n}\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS {n}\nDATA binary\n".encode()
    lines = ["property float x", "property float y", "property float z", "property uchar red", "property uchar green", "property uchar blue"]
    return ("\n".join(["ply", "format binary_little_endian 1.0", f"element vertex {n}", *lines, "end_header"]) + "\n").encode()


def parse_ply_header(raw: bytes) -> dict:
    """As :func:`parse_header`, for files with the properties of ``RECORDS["ply"]``."""
    end = raw.find(b"end_header\n")
    if not raw.startswith(b"ply") or end < 0:
        raise ValueError("no PLY header")
    lines = raw[:end].decode("ascii", "replace").split("\n")
    if "format binary_little_endian 1.0" not in lines or [x for x in lines if x.startswith("property")] != [x for x in header_of("ply", 0).decode().split("\n") if x.startswith("property")]:
        raise ValueError("PLY of another layout")
    return {"fields": list(RECORDS["ply"].names), "points": int(next(x for x in lines if x.startswith("element vertex")).split()[2]), "data": "binary", "start": end + 11, "kind": "ply"}


def read_header(f, kind: str) -> dict:
    """The header of an open file; more of the file is read as long as it does not end."""
    size, parse = 1 << 12, parse_header if kind == "pcd" else parse_ply_header
    while True:
        f.seek(0)
        raw = f.read(size)
        try:
            return parse(raw)
        except ValueError:
            if len(raw) < size or size > 1 << 24:
                raise
        size *= 8


def _record(header: dict) -> np.dtype:
    if header.get("kind") == "ply":
        return RECORDS["ply"]
    return np.dtype([(f, TYPES[k][0], (c,) if c > 1 else ()) for f, k, c in zip(header["fields"], header["kinds"], header["counts"], strict=True)])


WANTED = ("x", "y", "z", "rgb", "rgba", "r", "g", "b")
WHOLE = ("rgb", "rgba", "red", "green", "blue")  # columns of type int


def schema(headers: list[dict], kind: str) -> str:
    """point_id and the wanted fields of any of the files."""
    wanted = WANTED if kind == "pcd" else RECORDS["ply"].names
    fields = [f for f in wanted if f in "xyz" or any(f in h["fields"] for h in headers) or kind == "ply"]
    return "point_id long" + "".join(f", {f} {'int' if f in WHOLE else 'float'}" for f in fields)


def _batch(ids: np.ndarray, fields: list[str], header: dict, column) -> pa.RecordBatch:
    """point_id and ``fields``, null where a file lacks one; packed colours as the bits of their four bytes."""
    arrays = [pa.array(ids, pa.int64())]
    for f in fields:
        kind = pa.int32() if f in WHOLE else pa.float32()
        if f not in header["fields"]:
            arrays.append(pa.nulls(len(ids), kind))
            continue
        v = np.ascontiguousarray(column(f))
        if f in ("rgb", "rgba") and v.dtype.itemsize == 4:
            v = v.view("<i4")
        arrays.append(pa.array(v.astype("<i4" if f in WHOLE else "<f4"), kind))
    return pa.RecordBatch.from_arrays(arrays, names=["point_id", *fields])


def decode(f, header: dict, base: int, first: int, last: int, fields: list[str], rows: int) -> Iterator[pa.RecordBatch]:
    """Records ``first`` to ``last`` of an open file; ids count from ``base``."""
    ways = {"binary": _binary, "binary_compressed": _compressed, "ascii": _ascii}
    for at, n, column in ways[header["data"]](f, header, first, last, rows):
        yield _batch(np.arange(base + at, base + at + n), fields, header, column)


def _binary(f, header: dict, first: int, last: int, rows: int):
    dtype = _record(header)
    f.seek(header["start"] + first * dtype.itemsize)
    for at in range(first, last, rows):
        n = min(rows, last - at)
        raw = f.read(n * dtype.itemsize)
        if len(raw) < n * dtype.itemsize:
            raise ValueError("fewer records than the header says")
        some = np.frombuffer(raw, dtype, n)
        yield at, n, some.__getitem__


def _compressed(f, header: dict, first: int, last: int, rows: int):
    f.seek(header["start"])
    packed, size = struct.unpack("<II", f.read(8))
    flat, at, found = lzf_decompress(f.read(packed), size), 0, {}
    for name, k, c in zip(header["fields"], header["kinds"], header["counts"], strict=True):  # field after field
        kind = np.dtype(TYPES[k][0])
        found[name] = np.frombuffer(flat, kind, header["points"] * c, at)
        at += header["points"] * c * kind.itemsize
    for at in range(first, last, rows):
        n = min(rows, last - at)
        yield at, n, lambda name, at=at, n=n: found[name][at : at + n]


def _number(text: str) -> float:
    try:
        return float(text)
    except ValueError:
        return float("nan")


def _ascii(f, header: dict, first: int, last: int, rows: int):
    """Lines as they come, blank ones left out; a value that is no number, or not there, is NaN (a packed colour: zero)."""
    places = dict(zip(header["fields"], np.cumsum([0, *header["counts"][:-1]]).tolist(), strict=True))
    f.seek(header["start"])
    rest, at, held = b"", first, []

    def made(lines: list[list[str]], at: int):
        def column(name: str) -> np.ndarray:
            i, kind = places[name], header["kinds"][header["fields"].index(name)][0]
            texts = [x[i] if i < len(x) else "" for x in lines]
            if name in ("rgb", "rgba") and kind != "F":
                whole = np.array([int(t) if t.lstrip("+-").isdigit() else 0 for t in texts], np.int64)
                return (whole & 0xFFFFFFFF).astype("<u4").view("<i4")
            numbers = np.array([_number(t) for t in texts])
            return np.nan_to_num(numbers).astype("<f4").view("<i4") if name in ("rgb", "rgba") else numbers.astype("<f4")

        return at, len(lines), column

    while at + len(held) < last:
        block = f.read(1 << 20)
        lines = (rest + block).split(b"\n")
        rest = lines.pop() if block else b""
        held += [x.decode("ascii", "replace").split() for x in lines if x.strip()][: last - at - len(held)]
        while len(held) >= rows:
            yield made(held[:rows], at)
            at, held = at + rows, held[rows:]
        if not block:
            break
    if held:
        yield made(held, at)
        at += len(held)
    if at < last:
        raise ValueError("fewer lines than the header says")
