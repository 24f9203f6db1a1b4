"""PLY and PCD files as arrays, independent of Spark."""

from __future__ import annotations

from dataclasses import dataclass
from typing import BinaryIO

import numpy as np

# Fixed names of the PLY format and their numpy types.
PLY_TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}
HEADER_LINES = 10_000


@dataclass
class Header:
    """What a file's head says: fields with numpy types, how many points, and how they are written."""

    names: list[str]
    types: list[str]
    points: int
    ascii: bool

    def column(self, *names: str) -> str | None:
        return next((n for n in names if n in self.names), None)

    @property
    def intensity(self) -> str | None:
        return next((n for n in self.names if "intensity" in n), None)

    @property
    def rgb(self) -> bool:
        return all(c in self.names for c in ("red", "green", "blue")) or all(c in self.names for c in "rgb") or bool(self.column("rgb", "rgba"))


def _lines(f: BinaryIO):
    for _ in range(HEADER_LINES):
        line = f.readline()
        if not line:
            raise ValueError("the header has no end")
        yield line.decode("ascii", "replace").strip()


def ply_header(f: BinaryIO) -> Header:
    if f.readline().strip() != b"ply":
        raise ValueError("not a PLY file")
    out, element, first, known = Header([], [], 0, False), None, None, False
    for line in _lines(f):
        words = line.split()
        if not words or words[0] in ("comment", "obj_info"):
            continue
        if words[0] == "format":
            if words[1] == "binary_big_endian":
                raise ValueError("big-endian PLY files are not read")
            known, out.ascii = words[1] == "ascii" or "binary" in words[1], words[1] == "ascii"
        elif words[0] == "element":
            element = words[1]
            first = first or element
            if element == "vertex":
                out.points = int(words[2])
        elif words[0] == "property" and element == "vertex":
            if words[1] == "list":
                raise ValueError("list properties of vertices are not read")
            out.names.append(words[2])
            out.types.append(PLY_TYPES[words[1]])
        elif words[0] == "end_header":
            break
    if not known:
        raise ValueError("no known format line")
    if first != "vertex" or out.points < 1:
        raise ValueError("no vertices")
    return _with_xyz(out)


def pcd_header(f: BinaryIO) -> Header:
    got: dict[str, list[str]] = {}
    for line in _lines(f):
        words = line.split()
        if not words or words[0].startswith("#"):
            continue
        got[words[0].upper()] = words[1:]
        if words[0].upper() == "DATA":
            break
    data = got["DATA"][0].lower()
    if data not in ("ascii", "binary"):
        raise ValueError(f"DATA {data} is not read")
    kinds = {"F": "f", "U": "u", "I": "i"}
    counts = [int(c) for c in got.get("COUNT", ["1"] * len(got["FIELDS"]))]
    names, types = [], []
    for name, kind, size, n in zip(got["FIELDS"], got["TYPE"], got["SIZE"], counts):
        for k in range(n):
            names.append(name if n == 1 else f"{name}_{k}")
            types.append(f"{kinds[kind.upper()]}{size}")
    points = int(got["POINTS"][0]) if "POINTS" in got else int(got["WIDTH"][0]) * int(got["HEIGHT"][0])
    if points < 1:
        raise ValueError("no points")
    return _with_xyz(Header(names, types, points, data == "ascii"))


def _with_xyz(h: Header) -> Header:
    if not all(c in h.names for c in "xyz"):
        raise ValueError("x, y and z are needed")
    return h


def read_columns(f: BinaryIO, h: Header, rgb: bool = True, intensity: bool = True) -> dict[str, np.ndarray]:
    """x, y, z, and r, g, b, a in [0, 1] and intensity where the file has them and they are wanted."""
    kind = np.dtype([(n, "<" + t) for n, t in zip(h.names, h.types)])
    if h.ascii:
        rows = [f.readline().split() for _ in range(h.points)]
        if any(len(r) < len(h.names) for r in rows):
            raise ValueError("the file breaks off")
        data = {n: np.array([r[k] for r in rows]).astype(np.float64) for k, n in enumerate(h.names)}
        if (packed := h.column("rgb", "rgba")) and h.types[h.names.index(packed)].startswith("f"):
            data[packed] = data[packed].astype(np.float32).view(np.uint32)
    else:
        raw = f.read(kind.itemsize * h.points)
        if len(raw) < kind.itemsize * h.points:
            raise ValueError("the file breaks off")
        rows = np.frombuffer(raw, kind)
        data = {n: rows[n] for n in h.names}
    out = {c: data[c].astype(np.float64) for c in "xyz"}
    if rgb and h.rgb:
        if packed := h.column("rgb", "rgba"):
            v = np.ascontiguousarray(data[packed])
            v = v.view(np.uint32) if v.dtype == np.float32 else v.astype(np.uint32)
            parts = [(v >> s) & 255 for s in (16, 8, 0)]
        else:
            parts = [data[c] for c in (("red", "green", "blue") if "red" in h.names else "rgb")]
        out |= {c: p.astype(np.float64) / 255 for c, p in zip("rgb", parts)}
        out["a"] = np.ones(h.points)
    if intensity and h.intensity:
        out["intensity"] = data[h.intensity].astype(np.float64)
    return out


def _bytes(v: np.ndarray) -> np.ndarray:
    return np.clip(np.nan_to_num(v) * 255, 0, 255).astype(np.uint8)


def finite_rows(cols: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    ok = np.isfinite(np.stack([cols[c] for c in "xyz"])).all(0) if len(cols["x"]) else np.zeros(0, bool)
    if not ok.any():
        raise ValueError("there is no valid point to write")
    return {k: v[ok] for k, v in cols.items()}


def write_ply(f: BinaryIO, cols: dict[str, np.ndarray], ascii: bool = False) -> None:
    cols = finite_rows(cols)
    fields = [(c, "<f4", "float", cols[c].astype(np.float32)) for c in "xyz"]
    if all(c in cols for c in "rgb"):
        fields += [(n, "u1", "uchar", _bytes(cols[c])) for c, n in zip("rgb", ("red", "green", "blue"))]
    if "intensity" in cols:
        fields.append(("intensity", "<f4", "float", cols["intensity"].astype(np.float32)))
    head = ["ply", f"format {'ascii' if ascii else 'binary_little_endian'} 1.0", f"element vertex {len(cols['x'])}", *(f"property {k} {n}" for n, _, k, _ in fields), "end_header", ""]
    f.write("\n".join(head).encode())
    _body(f, fields, ascii)


def write_pcd(f: BinaryIO, cols: dict[str, np.ndarray], ascii: bool = False) -> None:
    """Colours are packed into one unsigned field; intensities are not written."""
    cols = finite_rows(cols)
    fields = [(c, "<f4", "F", cols[c].astype(np.float32)) for c in "xyz"]
    if all(c in cols for c in "rgb"):
        r, g, b = (_bytes(cols[c]).astype(np.uint32) for c in "rgb")
        fields.append(("rgb", "<u4", "U", r << 16 | g << 8 | b))
    n = len(cols["x"])
    head = ["# .PCD v0.7", "VERSION 0.7", "FIELDS " + " ".join(x[0] for x in fields), "SIZE " + " ".join(x[1][-1] for x in fields), "TYPE " + " ".join(x[2] for x in fields), "COUNT" + " 1" * len(fields), f"WIDTH {n}", "HEIGHT 1", "VIEWPOINT 0 0 0 1 0 0 0", f"POINTS {n}", f"DATA {'ascii' if ascii else 'binary'}", ""]
    f.write("\n".join(head).encode())
    _body(f, fields, ascii)


def _body(f: BinaryIO, fields: list, ascii: bool) -> None:
    if ascii:
        text = [[f"{v:.6f}" for v in col] if kind == "<f4" else [str(int(v)) for v in col] for _, kind, _, col in fields]
        f.write("".join(" ".join(row) + "\n" for row in zip(*text)).encode())
    else:
        rows = np.empty(len(fields[0][3]), [(n, k) for n, k, _, _ in fields])
        for n, _, _, col in fields:
            rows[n] = col
        f.write(rows.tobytes())
