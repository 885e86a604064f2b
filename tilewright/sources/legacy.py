"""Data sources ``gpkg`` (GeoPackage) and ``shapefile``. Files must lie in a folder that driver and executors share; tasks read ranges of rows."""

from __future__ import annotations

import os
import sqlite3
import struct
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from tilewright.functions.geometry import LINE, MULTILINE, MULTIPOINT, MULTIPOLYGON, POINT, POLYGON, area2, to_wkb
from tilewright.operators.clip import _inside

ROWS = 20_000


@dataclass
class Rows(InputPartition):
    first: int
    last: int


def local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


# ---- GeoPackage ------------------------------------------------------------------------------------------------------------

_SQLITE = (("INT", T.LongType()), ("BOOL", T.BooleanType()), ("REAL", T.DoubleType()), ("DOUBLE", T.DoubleType()), ("FLOAT", T.DoubleType()))


def gpkg_layer(path: str, layer: str | None) -> tuple[str, str, int, list[tuple[str, T.DataType]]]:
    """Table, geometry column, EPSG code and columns."""
    with sqlite3.connect(f"file:{local(path)}?mode=ro", uri=True) as db:
        found = db.execute("SELECT table_name, column_name, srs_id FROM gpkg_geometry_columns").fetchall()
        one = next((f for f in found if layer in (None, f[0])), None)
        if one is None:
            raise ValueError(f"{path} has no layer {layer or ''}")
        code = db.execute("SELECT organization_coordsys_id FROM gpkg_spatial_ref_sys WHERE srs_id = ?", (one[2],)).fetchone()
        columns = []
        for _, name, kind, *_ in db.execute(f'PRAGMA table_info("{one[0]}")'):
            spark = T.BinaryType() if name == one[1] else next((t for k, t in _SQLITE if k in (kind or "").upper()), T.StringType())
            columns.append((name, spark))
    return one[0], one[1], int(code[0]) if code else one[2], columns


def gpkg_wkb(blob: bytes | None) -> bytes | None:
    """WKB behind the header of a GeoPackage blob; None if marked empty."""
    if not blob or blob[:2] != b"GP" or blob[3] & 16:
        return None
    return blob[8 + (0, 32, 48, 48, 64)[min(blob[3] >> 1 & 7, 4)] :]


class GeoPackage(DataSource):
    @classmethod
    def name(cls):
        return "gpkg"

    def schema(self):
        return T.StructType([T.StructField(n, t) for n, t in gpkg_layer(self.options["path"], self.options.get("layer"))[3]])

    def reader(self, schema):
        return GeoPackageReader(self.options, schema)


class GeoPackageReader(DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.layer, self.fields = local(options["path"]), options.get("layer"), schema

    def partitions(self):
        table = gpkg_layer(self.path, self.layer)[0]
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{table}"').fetchone()
        return [Rows(a, a + ROWS) for a in range(low, high + 1, ROWS)] if low is not None else [Rows(0, 0)]

    def read(self, part):
        table, geometry, _, _ = gpkg_layer(self.path, self.layer)
        names = self.fields.names
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            columns = ", ".join('"' + n.replace('"', '""') + '"' for n in names)
            rows = db.execute(f'SELECT {columns} FROM "{table}" WHERE rowid >= ? AND rowid < ? ORDER BY rowid', (part.first, part.last)).fetchall()
        out = []
        for field, column in zip(self.fields, zip(*rows) if rows else [()] * len(names)):
            if field.name == geometry:
                column = map(gpkg_wkb, column)
            elif isinstance(field.dataType, T.BooleanType):
                column = (None if v is None else bool(v) for v in column)
            elif isinstance(field.dataType, T.StringType):
                column = (v if v is None or isinstance(v, str) else str(v) for v in column)
            elif isinstance(field.dataType, T.DoubleType):
                column = (None if v is None else float(v) for v in column)
            out.append(list(column))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, to_arrow_schema(self.fields).types)], names)


# ---- Shapefile -------------------------------------------------------------------------------------------------------------


def _beside(path: str, suffix: str) -> str | None:
    stem = os.path.splitext(local(path))[0]
    return next((stem + s for s in (suffix, suffix.upper()) if os.path.exists(stem + s)), None)


def dbf_fields(path: str) -> tuple[int, int, int, list[tuple[str, str, int, int]]]:
    """Rows, bytes of the header and of a row, and fields (name, type, width, decimals)."""
    with open(path, "rb") as f:
        head = f.read(32)
        rows, header, width = struct.unpack("<IHH", head[4:12])
        fields = []
        while (one := f.read(32)) and one[0] != 0x0D:
            fields.append((one[:11].split(b"\0")[0].decode("utf-8", "replace"), chr(one[11]), one[16], one[17]))
    return rows, header, width, fields


def _dbf_type(kind: str, decimals: int) -> T.DataType:
    if kind in "NF":
        return T.DoubleType() if decimals or kind == "F" else T.LongType()
    return T.BooleanType() if kind == "L" else T.StringType()


def _dbf_value(raw: bytes, kind: T.DataType):
    text = raw.decode("utf-8", "replace").strip(" \0")
    if isinstance(kind, T.StringType):
        return text or None
    if isinstance(kind, T.BooleanType):
        return True if text in "YyTt" and text else False if text in "NnFf" and text else None
    try:
        return int(float(text)) if isinstance(kind, T.LongType) else float(text)
    except ValueError:
        return None


def shape_geometry(data: bytes):
    """A record's geometry; rings are outer if clockwise, and holes go to the ring around them."""
    kind = struct.unpack_from("<i", data)[0] % 10
    if kind == 1:
        return POINT, [[[struct.unpack_from("<2d", data, 4)]]]
    if kind == 8:
        n = struct.unpack_from("<i", data, 36)[0]
        v = struct.unpack_from(f"<{2 * n}d", data, 40)
        return MULTIPOINT, [[[p]] for p in zip(v[::2], v[1::2])]
    if kind not in (3, 5):
        return None
    parts, n = struct.unpack_from("<2i", data, 36)
    starts = [*struct.unpack_from(f"<{parts}i", data, 44), n]
    v = struct.unpack_from(f"<{2 * n}d", data, 44 + 4 * parts)
    points = list(zip(v[::2], v[1::2]))
    runs = [points[a:b] for a, b in zip(starts, starts[1:])]
    if kind == 3:
        lines = [[r] for r in runs if len(r) > 1]
        return (LINE if len(lines) == 1 else MULTILINE, lines) if lines else None
    rings = [r for r in runs if len(r) > 3]
    outer = [[r] for r in rings if area2(r) <= 0] or [[r] for r in rings[:1]]
    for hole in rings:
        if area2(hole) > 0 and not any(hole is o[0] for o in outer):
            home = next((o for o in outer if _inside(hole[0], o[0])), outer[0])
            home.append(hole)
    return (POLYGON if len(outer) == 1 else MULTIPOLYGON, outer) if outer else None


class Shapefile(DataSource):
    @classmethod
    def name(cls):
        return "shapefile"

    def schema(self):
        dbf = _beside(self.options["path"], ".dbf")
        fields = [T.StructField(n, _dbf_type(k, d)) for n, k, _, d in dbf_fields(dbf)[3]] if dbf else []
        return T.StructType([*fields, T.StructField("geometry", T.BinaryType())])

    def reader(self, schema):
        return ShapefileReader(self.options, schema)


class ShapefileReader(DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.fields = local(options["path"]), schema

    def partitions(self):
        n = (os.path.getsize(_beside(self.path, ".shx")) - 100) // 8
        return [Rows(a, min(n, a + ROWS)) for a in range(0, n, ROWS)] or [Rows(0, 0)]

    def read(self, part):
        dbf = _beside(self.path, ".dbf")
        with open(_beside(self.path, ".shx"), "rb") as f:
            f.seek(100 + 8 * part.first)
            index = list(struct.iter_unpack(">2i", f.read(8 * (part.last - part.first))))
        shapes, columns = [], [[] for _ in range(len(self.fields) - 1)]
        with open(self.path, "rb") as f:
            for offset, length in index:
                f.seek(2 * offset + 8)
                g = shape_geometry(f.read(2 * length))
                shapes.append(to_wkb(g) if g else None)
        if dbf:
            _, header, width, fields = dbf_fields(dbf)
            with open(dbf, "rb") as f:
                f.seek(header + part.first * width)
                for _ in index:
                    row, at = f.read(width), 1
                    for column, (_, kind, size, decimals) in zip(columns, fields):
                        column.append(_dbf_value(row[at : at + size], _dbf_type(kind, decimals)))
                        at += size
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*columns, shapes], to_arrow_schema(self.fields).types)], self.fields.names)


def shapefile_crs(path: str) -> str:
    """From the ``.prj`` beside the file; without one, longitude and latitude."""
    prj = _beside(path, ".prj")
    if prj is None:
        return "EPSG:4326"
    with open(prj, encoding="utf-8", errors="replace") as f:
        text = f.read()
    from tilewright.functions.crs import known

    known(text)  # refused here, with the file at hand, rather than in a task
    return text
