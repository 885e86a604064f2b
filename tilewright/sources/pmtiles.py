"""PMTiles version 3 archives: a Spark data source ``pmtiles`` that reads and writes them, and metadata.

Writing: rows ``(tile_id, data)`` come sorted by disjoint ranges of ``tile_id``. Each task writes its tiles one after another to a part file beside the
archive, and its directory entries to another; equal neighbours share their bytes, runs of them one entry. The commit, on the driver, reads entries part by
part, packs leaf directories and joins the files. The folder must be one that driver and executors share.
"""

from __future__ import annotations

import gzip
import json
import os
import shutil
import struct
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tilewright.operators.encode import read_varint, varint

# Fixed values of the format.
HEADER_BYTES, ROOT_LIMIT, LEAF_ENTRIES = 127, 16384 - 127, 4096
#: Compressed bytes of tiles that one task of a reader takes, about, and bytes that it hands on at once.
SLICE_BYTES, HELD_BYTES = 1 << 20, 8 << 20
TILE_TYPES = {"mvt": 1, "mlt": 6}
GZIP = 2
HEADER = "<7sB11QBBBBBBiiiiBii"
ENTRY = struct.Struct("<QQII")  # tile id, offset, length, run


def hilbert_to_tile(tile_id: int) -> tuple[int, int, int]:
    z, first = 0, 0
    while tile_id >= first + 4**z:
        first += 4**z
        z += 1
    d, x, y = tile_id - first, 0, 0
    for level in range(z):
        s = 1 << level
        rx = d >> 1 & 1
        ry = (d ^ rx) & 1
        if not ry:
            if rx:
                x, y = s - 1 - x, s - 1 - y
            x, y = y, x
        x, y = x + s * rx, y + s * ry
        d >>= 2
    return z, x, y


def pack_directory(entries) -> bytes:
    """Entries (id, offset, length, run) as compressed delta columns."""
    ids = [e[0] for e in entries]
    out = [varint(len(entries))]
    out += [varint(b - a) for a, b in zip([0, *ids], ids)]
    out += [varint(e[3]) for e in entries]
    out += [varint(e[2]) for e in entries]
    expected = None
    for _, offset, length, _ in entries:
        out.append(varint(0) if offset == expected else varint(offset + 1))
        expected = offset + length
    return gzip.compress(b"".join(out), 6, mtime=0)


def unpack_directory(data: bytes):
    data, at = gzip.decompress(data), 0
    n, at = read_varint(data, at)
    columns = []
    for _ in range(4):
        column = []
        for _ in range(n):
            v, at = read_varint(data, at)
            column.append(v)
        columns.append(column)
    out, tile, expected = [], 0, 0
    for step, run, length, offset in zip(*columns):
        tile += step
        offset = expected if offset == 0 else offset - 1
        out.append((tile, offset, length, run))
        expected = offset + length
    return out


@dataclass
class Part(WriterCommitMessage):
    first: int
    name: str
    size: int
    entries: int
    tiles: int
    contents: int


class Writer(DataSourceArrowWriter):
    def __init__(self, options):
        self.path = options["path"].removeprefix("file:")
        self.info = json.loads(options.get("info", "{}"))
        self.overwrite = options.get("replace", "false") == "true"
        self.parts = self.path + ".parts"

    def write(self, batches):
        import uuid

        os.makedirs(self.parts, exist_ok=True)
        name = uuid.uuid4().hex
        size = entries = tiles = contents = 0
        first, last = None, None
        seen: dict[bytes, tuple[int, int]] = {}
        with open(f"{self.parts}/{name}.data", "wb") as data, open(f"{self.parts}/{name}.entries", "wb") as index:
            for tile, body in (pair for b in batches for pair in zip(b.column("tile_id").to_pylist(), b.column("data").to_pylist())):
                tiles += 1
                first = tile if first is None else first
                if body in seen:
                    offset, length = seen[body]
                else:
                    offset, length = size, len(body)
                    data.write(body)
                    size += length
                    contents += 1
                    if length <= 1024 and len(seen) < 4096:  # only small tiles, such as full ones, repeat
                        seen[body] = (offset, length)
                if last and last[1] == offset and last[0] + last[3] == tile:
                    last = (*last[:3], last[3] + 1)
                    continue
                if last:
                    index.write(ENTRY.pack(*last))
                    entries += 1
                last = (tile, offset, length, 1)
            if last:
                index.write(ENTRY.pack(*last))
                entries += 1
        return Part(first if first is not None else -1, name, size, entries, tiles, contents)

    def commit(self, messages):
        parts = sorted((m for m in messages if m and m.tiles), key=lambda m: m.first)
        try:
            if not parts:
                raise ValueError("No tiles generated")
            self._join(parts)
        finally:
            shutil.rmtree(self.parts, ignore_errors=True)

    def _join(self, parts) -> None:
        def entries():
            start = 0
            for part in parts:
                with open(f"{self.parts}/{part.name}.entries", "rb") as f:
                    while block := f.read(ENTRY.size * 8192):
                        for tile, offset, length, run in ENTRY.iter_unpack(block):
                            yield tile, offset + start, length, run
                start += part.size

        total = sum(p.entries for p in parts)
        leaves_path = f"{self.parts}/leaves"
        root = None
        if total <= LEAF_ENTRIES:
            root = pack_directory(list(entries()))
            if len(root) > ROOT_LIMIT:
                root = None
        size = LEAF_ENTRIES
        open(leaves_path, "wb").close()
        while root is None:
            pointers, at, batch = [], 0, []

            def leaf(f):
                nonlocal at
                packed = pack_directory(batch)
                f.write(packed)
                pointers.append((batch[0][0], at, len(packed), 0))
                at += len(packed)
                batch.clear()

            with open(leaves_path, "wb") as f:
                for e in entries():
                    batch.append(e)
                    if len(batch) == size:
                        leaf(f)
                if batch:
                    leaf(f)
            root = pack_directory(pointers)
            if len(root) > ROOT_LIMIT:
                root, size = None, size * 2
        info = self.info
        meta = gzip.compress(json.dumps({"vector_layers": info.get("vector_layers", [])}, separators=(",", ":")).encode(), 6, mtime=0)
        leaf_size, data_size = os.path.getsize(leaves_path), sum(p.size for p in parts)
        west, south, east, north = info.get("bounds", (-180, -85, 180, 85))
        low, high = info.get("min_zoom", 0), info.get("max_zoom", 0)
        e7 = lambda v: int(round(v * 1e7))
        at_meta = HEADER_BYTES + len(root)
        at_leaf = at_meta + len(meta)
        at_data = at_leaf + leaf_size
        tiles, contents = sum(p.tiles for p in parts), sum(p.contents for p in parts)
        header = struct.pack(
            HEADER, b"PMTiles", 3, HEADER_BYTES, len(root), at_meta, len(meta), at_leaf, leaf_size, at_data, data_size, tiles, total, contents,
            1, GZIP, GZIP, TILE_TYPES[info.get("tile_format", "mvt")], low, high, e7(west), e7(south), e7(east), e7(north), (low + high) // 2, e7((west + east) / 2), e7((south + north) / 2),
        )
        # written beside the archive and renamed when whole: a driver that is lost midway leaves the old archive as it was
        whole = f"{self.parts}/whole"
        with open(whole, "wb") as out:
            out.write(header + root + meta)
            for name in ["leaves", *(f"{part.name}.data" for part in parts)]:
                _append(f"{self.parts}/{name}", out)
            out.flush()
            os.fsync(out.fileno())
        if self.overwrite:
            os.replace(whole, self.path)
        else:
            os.link(whole, self.path)  # fails if there is one by now

    def abort(self, messages):
        shutil.rmtree(self.parts, ignore_errors=True)


def _append(path: str, out) -> None:
    """Copied by the system where it can, so that bytes do not pass through this process."""
    with open(path, "rb") as f:
        size, at = os.path.getsize(path), 0
        out.flush()
        while at < size:
            try:
                done = os.sendfile(out.fileno(), f.fileno(), at, min(size - at, 1 << 30))
            except (OSError, AttributeError):
                break
            if not done:
                break
            at += done
        if at < size:
            f.seek(at)
            out.seek(0, os.SEEK_END)
            shutil.copyfileobj(f, out, 1 << 20)


@dataclass
class Slice(InputPartition):
    """Entries of the root that point to tiles, or a leaf directory by place and length; of its entries the part ``nth`` of ``parts``."""

    entries: list
    leaf: tuple[int, int] | None
    leaf_at: int
    data_at: int
    nth: int = 0
    parts: int = 1


class Reader(DataSourceReader):
    """Rows ``(z, x, y, tile_id, data)`` with tiles decompressed. The driver reads the root directory, which is small by format; a task reads some
    ``SLICE_BYTES`` of tiles, by the root or by its part of a leaf directory."""

    def __init__(self, options):
        self.path = options["path"].removeprefix("file:")

    def partitions(self):
        with open(self.path, "rb") as f:
            h = header_of(f)
            f.seek(h["root_offset"])
            root = unpack_directory(f.read(h["root_length"]))
        out, own, size = [], [], 0
        for e in (e for e in root if e[3]):
            # a run of equal tiles is read once, but made as often as it says
            if own and (size + e[2] * e[3] > SLICE_BYTES or len(own) == 2048):
                out.append(Slice(own, None, h["leaf_offset"], h["data_offset"]))
                own, size = [], 0
            own.append(e)
            size += e[2] * e[3]
        if own:
            out.append(Slice(own, None, h["leaf_offset"], h["data_offset"]))
        leaves = [(h["leaf_offset"] + offset, length) for _, offset, length, run in root if not run]
        parts = min(LEAF_ENTRIES, -(-h["data_length"] // max(1, len(leaves)) // SLICE_BYTES) or 1)
        return out + [Slice([], leaf, h["leaf_offset"], h["data_offset"], k, parts) for leaf in leaves for k in range(parts)] or [Slice([], None, 0, 0)]

    def read(self, part):
        rows, held = [], 0

        def made():
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["z", "x", "y", "tile_id", "data"])

        with open(self.path, "rb") as f:

            def entries(found):
                for entry in found:
                    if entry[3]:
                        yield entry
                    else:
                        f.seek(part.leaf_at + entry[1])
                        yield from entries(unpack_directory(f.read(entry[2])))

            found = part.entries
            if part.leaf:
                f.seek(part.leaf[0])
                found = unpack_directory(f.read(part.leaf[1]))
                found = found[len(found) * part.nth // part.parts : len(found) * (part.nth + 1) // part.parts]
            for tile, offset, length, run in entries(found):
                f.seek(part.data_at + offset)
                body = gzip.decompress(f.read(length))
                for t in range(tile, tile + run):
                    rows.append((*hilbert_to_tile(t), t, body))
                    held += len(body)
                    if held > HELD_BYTES:
                        yield made()
                        rows, held = [], 0
        yield made()


class PMTiles(DataSource):
    @classmethod
    def name(cls):
        return "pmtiles"

    def schema(self):
        return "z int, x long, y long, tile_id long, data binary"

    def reader(self, schema):
        return Reader(self.options)

    def writer(self, schema, overwrite):
        return Writer(self.options)


def header_of(f) -> dict:
    f.seek(0)
    raw = f.read(HEADER_BYTES)
    if raw[:7] != b"PMTiles" or raw[7] != 3:
        raise ValueError("not a PMTiles version 3 archive")
    names = "magic version root_offset root_length metadata_offset metadata_length leaf_offset leaf_length data_offset data_length num_tiles num_entries num_contents clustered internal_compression tile_compression tile_type min_zoom max_zoom west south east north center_zoom center_lon center_lat".split()
    return dict(zip(names, struct.unpack(HEADER, raw)))


def pmtiles_metadata(path: str | Path) -> dict:
    """Zooms, centre, bounds, format, number of tiles and the JSON metadata of an archive."""
    path = str(path).removeprefix("file:")
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    with open(path, "rb") as f:
        h = header_of(f)
        f.seek(h["metadata_offset"])
        meta = json.loads(gzip.decompress(f.read(h["metadata_length"])))
    return {
        "min_zoom": h["min_zoom"],
        "max_zoom": h["max_zoom"],
        "center": (h["center_lon"] / 1e7, h["center_lat"] / 1e7, h["center_zoom"]),
        "bounds": tuple(h[k] / 1e7 for k in ("west", "south", "east", "north")),
        "tile_format": {v: k for k, v in TILE_TYPES.items()}.get(h["tile_type"], "unknown"),
        "num_tiles": h["num_tiles"],
        "clustered": bool(h["clustered"]),
        **meta,
    }
