"""Bytes of a tile: Mapbox Vector Tiles (protobuf, version 2) and MapLibre Tiles (columnar), with decoders for tests and readers.

A layer is ``(name, property names, features)``, a feature ``(id or None, geometry, values)`` with geometry in whole tile units.
"""

from __future__ import annotations

import struct
from itertools import groupby

from tilewright.functions.geometry import LINE, MULTILINE, MULTIPOINT, MULTIPOLYGON, POINT, POLYGON, Geometry

EXTENT = 4096
_SMALL = [bytes([v]) if v < 128 else bytes([v & 127 | 128, v >> 7]) for v in range(1 << 14)]


def varint(v: int) -> bytes:
    if v < 1 << 14:
        return _SMALL[v]
    out = bytearray()
    while v > 127:
        out.append(v & 127 | 128)
        v >>= 7
    out.append(v)
    return bytes(out)


def zigzag(v: int) -> int:
    return v << 1 if v >= 0 else (-v << 1) - 1


def unzigzag(v: int) -> int:
    return v >> 1 if not v & 1 else -(v + 1 >> 1)


def _field(number: int, body: bytes) -> bytes:
    return varint(number << 3 | 2) + varint(len(body)) + body


# ---- Mapbox Vector Tiles -------------------------------------------------------------------------------------------------


def commands(g: Geometry) -> list[int]:
    """The command stream of a geometry; empty if nothing of it can be drawn. The cursor moves only with what is written."""
    kind, members = g
    base = (kind - 1) % 3 + 1
    out: list[int] = []
    cx = cy = 0
    if base == POINT:
        points = [p for m in members for p in m[0]]
        out.append(1 | len(points) << 3)
        for x, y in points:
            out += (zigzag(int(x) - cx), zigzag(int(y) - cy))
            cx, cy = int(x), int(y)
        return out
    for part in (p for m in members for p in _drawn(m, base)):
        out.append(1 | 1 << 3)
        body = []
        for k, (x, y) in enumerate(part):
            pair = (zigzag(x - cx), zigzag(y - cy))
            cx, cy = x, y
            if k:
                body += pair
            else:
                out += pair
        out.append(2 | (len(part) - 1) << 3)
        out += body
        if base == POLYGON:
            out.append(7 | 1 << 3)
    return out


def _drawn(member, base: int) -> list[list[tuple[int, int]]]:
    """Parts of a member that can be drawn, open and without repeated vertices; a polygon without outer ring has none."""
    parts = []
    for k, part in enumerate(member):
        own: list[tuple[int, int]] = []
        for x, y in part:
            p = (_whole(x), _whole(y))
            if not own or own[-1] != p:
                own.append(p)
        if base == POLYGON and len(own) > 1 and own[0] == own[-1]:
            own.pop()
        if len(own) >= (2 if base == LINE else 3):
            parts.append(own)
        elif k == 0:
            return []
    return parts


def _whole(v) -> int:
    if isinstance(v, int):
        return v
    return int(v + 0.5) if v >= 0 else -int(0.5 - v)


def _value(v) -> bytes:
    if isinstance(v, bool):
        return b"\x38" + (b"\x01" if v else b"\x00")
    if isinstance(v, int):
        return b"\x20" + varint(v & 0xFFFFFFFFFFFFFFFF)
    if isinstance(v, float):
        return b"\x19" + struct.pack("<d", v)
    return _field(1, str(v).encode())


class MvtFeatures:
    """One layer, made feature by feature: the bytes so far and the dictionary are all that is held. Features without drawable geometry are left out."""

    def __init__(self, name: str, names: list[str]):
        self.name, self.names = name, names
        self.body, self.drawn = bytearray(_field(1, name.encode())), False
        self.keys: list[str] = []
        self.values: dict = {}
        self.places: list[bytes | None] = [None] * len(names)

    def add(self, fid: int | None, g: Geometry, props) -> None:
        if g[0] == POINT:
            x, y = g[1][0][0][0]
            stream = b"\x09" + varint(zigzag(int(x))) + varint(zigzag(int(y)))
        else:
            stream = b"".join(map(varint, commands(g)))
            if not stream:
                return
        self.drawn = True
        tags, places, values = [], self.places, self.values
        for k, v in enumerate(props):
            if v is None:
                continue
            if places[k] is None:
                places[k] = varint(len(self.keys))
                self.keys.append(self.names[k])
            own = (v.__class__, v)
            at = values.get(own)
            if at is None:
                at = values[own] = varint(len(values))
            tags += (places[k], at)
        one = b"" if fid is None else b"\x08" + varint(fid & 0xFFFFFFFFFFFFFFFF)
        if tags:
            packed = b"".join(tags)
            one += b"\x12" + varint(len(packed)) + packed
        one += b"\x18" + bytes(((g[0] - 1) % 3 + 1, 34)) + varint(len(stream)) + stream
        self.body += b"\x12" + varint(len(one)) + one

    def finish(self) -> bytes:
        """The layer; none without features."""
        if not self.drawn:
            return b""
        parts = [self.body, *(_field(3, k.encode()) for k in self.keys), *(_field(4, _value(v)) for _, v in self.values), varint(5 << 3) + varint(EXTENT) + varint(15 << 3) + varint(2)]
        return b"".join((varint(3 << 3 | 2), varint(sum(map(len, parts))), *parts))


def encode_mvt(layers) -> bytes:
    """A tile; features without drawable geometry and layers without features are left out."""
    tile = []
    for name, names, features in layers:
        layer = MvtFeatures(name, names)
        for f in features:
            layer.add(*f)
        tile.append(layer.finish())
    return b"".join(tile)


def _fields(data: bytes):
    at = 0
    while at < len(data):
        key, at = read_varint(data, at)
        if key & 7 == 0:
            v, at = read_varint(data, at)
        elif key & 7 == 1:
            v, at = data[at : at + 8], at + 8
        elif key & 7 == 5:
            v, at = data[at : at + 4], at + 4
        else:
            n, at = read_varint(data, at)
            v, at = data[at : at + n], at + n
        yield key >> 3, v


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    v = shift = 0
    while True:
        b = data[at]
        at += 1
        v |= (b & 127) << shift
        if b < 128:
            return v, at
        shift += 7


def _packed(data: bytes) -> list[int]:
    out, at = [], 0
    while at < len(data):
        v, at = read_varint(data, at)
        out.append(v)
    return out


def decode_mvt(data: bytes) -> list[dict]:
    """Layers with name, extent, version, keys, values and features of id, kind (1 to 3), commands, parts in tile units and properties."""
    out = []
    for number, body in _fields(data):
        if number != 3:
            continue
        layer, keys, values, raw = {"name": "", "extent": EXTENT, "version": 1, "features": []}, [], [], []
        for n, v in _fields(body):
            if n == 1:
                layer["name"] = v.decode()
            elif n == 2:
                raw.append(v)
            elif n == 3:
                keys.append(v.decode())
            elif n == 4:
                for k, x in _fields(v):
                    values.append({1: lambda x: x.decode(), 3: lambda x: struct.unpack("<d", x)[0], 2: lambda x: struct.unpack("<f", x)[0], 4: lambda x: x - (1 << 64) if x >> 63 else x, 5: int, 6: unzigzag, 7: bool}[k](x))
            elif n == 5:
                layer["extent"] = v
            elif n == 15:
                layer["version"] = v
        layer["features"] = [feature_of(f, keys, values) for f in raw]
        layer["keys"], layer["values"] = keys, values
        out.append(layer)
    return out


def feature_of(data: bytes, keys: list[str], values: list) -> dict:
    one = {"id": None, "kind": 0, "parts": [], "properties": {}}
    for n, v in _fields(data):
        if n == 1:
            one["id"] = v
        elif n == 2:
            tags = _packed(v)
            one["properties"] = {keys[k]: values[x] for k, x in zip(tags[::2], tags[1::2])}
        elif n == 3:
            one["kind"] = v
        elif n == 4:
            one["commands"] = _packed(v)
            one["parts"] = _parts(one["commands"])
    return one


def _parts(stream: list[int]) -> list[list[tuple[int, int]]]:
    parts, at, x, y = [], 0, 0, 0
    while at < len(stream):
        kind, count = stream[at] & 7, stream[at] >> 3
        at += 1
        if kind == 7:
            parts[-1].append(parts[-1][0])
            continue
        for _ in range(count):
            x, y = x + unzigzag(stream[at]), y + unzigzag(stream[at + 1])
            at += 2
            if kind == 1:
                parts.append([])
            parts[-1].append((x, y))
    return parts


# ---- MapLibre Tiles ------------------------------------------------------------------------------------------------------

# Fixed values of the format: column types (each plus one where a column has nulls), stream types, stream subtypes, techniques.
COLUMN_ID, COLUMN_GEOMETRY, COLUMN_BOOL, COLUMN_INT, COLUMN_DOUBLE, COLUMN_STRING = 2, 4, 10, 20, 26, 28
PRESENT, DATA, OFFSET, LENGTH = 0, 1, 2, 3
DATA_NONE, DATA_SINGLE, DATA_VERTEX, OFFSET_STRING = 0, 1, 3, 2
LENGTH_BINARY, LENGTH_GEOMETRIES, LENGTH_PARTS, LENGTH_RINGS, LENGTH_DICTIONARY = 0, 1, 2, 3, 6
LOGICAL_NONE, LOGICAL_DELTA, LOGICAL_COMPONENT_DELTA, LOGICAL_RLE = 0, 1, 2, 3
PHYSICAL_NONE, PHYSICAL_VARINT = 0, 2
GEOMETRY_CODES = {POINT: 0, LINE: 1, POLYGON: 2, MULTIPOINT: 3, MULTILINE: 4, MULTIPOLYGON: 5}


def byte_rle(data: bytes) -> bytes:
    """ORC byte run-length encoding: runs of 3 to 130, literals of up to 128."""
    runs = [(b, len(list(g))) for b, g in groupby(data)]
    out, literal = bytearray(), bytearray()

    def flush() -> None:
        while literal:
            piece = literal[:128]
            out.append(256 - len(piece))
            out.extend(piece)
            del literal[:128]

    for b, n in runs:
        while n >= 3:
            flush()
            take = min(n, 130)
            out.extend((take - 3, b))
            n -= take
        literal.extend([b] * n)
    flush()
    return bytes(out)


def byte_unrle(data: bytes, n: int) -> bytes:
    out, at = bytearray(), 0
    while len(out) < n:
        c = data[at]
        if c < 128:
            out.extend(data[at + 1 : at + 2] * (c + 3))
            at += 2
        else:
            out.extend(data[at + 1 : at + 1 + 256 - c])
            at += 1 + 256 - c
    return bytes(out[:n])


def _stream(kind: int, sub: int, logical: int, physical: int, n: int, body: bytes, more: bytes = b"") -> bytes:
    return bytes((kind << 4 | sub, logical << 5 | physical)) + varint(n) + varint(len(body)) + more + body


def run_count(values) -> int:
    return sum(1 for _ in groupby(values))


def _counts(sub: int, values: list[int]) -> bytes:
    """A stream of small numbers: run lengths, then run values, where that halves the numbers, else one by one."""
    runs = run_count(values)
    if runs * 2 < len(values):
        pairs = [(v, len(list(g))) for v, g in groupby(values)]
        body = b"".join(varint(n) for _, n in pairs) + b"".join(varint(v) for v, _ in pairs)
        return _stream(LENGTH, sub, LOGICAL_RLE, PHYSICAL_VARINT, runs * 2, body, varint(runs) + varint(len(values)))
    return _stream(LENGTH, sub, LOGICAL_NONE, PHYSICAL_VARINT, len(values), b"".join(map(varint, values)))


def column_type(values) -> int:
    """Code of a column, from what it holds in this tile: text before doubles, integers and booleans; a column of nulls is text."""
    kinds = {type(v) for v in values}
    nullable = type(None) in kinds
    kinds.discard(type(None))
    if not kinds:
        return COLUMN_STRING + 1
    base = COLUMN_STRING if kinds - {float, int, bool} else COLUMN_DOUBLE if float in kinds else COLUMN_INT if int in kinds else COLUMN_BOOL
    return base + nullable


def as_text(v) -> str:
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float) and v == int(v) and abs(v) < 1e16:
        return str(int(v))
    return str(v)


def dictionary_pays(texts: list[bytes]) -> tuple[bool, list[bytes]]:
    """Whether a dictionary costs less than the texts themselves, and its entries in order of appearance."""
    entries = list(dict.fromkeys(texts))
    if not texts or len(entries) >= len(texts):
        return False, entries
    place = {t: i for i, t in enumerate(entries)}
    size = lambda ts: sum(len(varint(len(t))) + len(t) for t in ts)
    return size(entries) + sum(len(varint(place[t])) for t in texts) + 12 < size(texts) + 8, entries


def _present(values) -> bytes:
    bits = bytearray((len(values) + 7) // 8)
    for i, v in enumerate(values):
        if v is not None:
            bits[i >> 3] |= 1 << (i & 7)
    return _stream(PRESENT, 0, LOGICAL_RLE, PHYSICAL_NONE, len(values), byte_rle(bytes(bits)))


def _column(code: int, values) -> bytes:
    nullable = None in values
    out = [_present(values)] if nullable else []
    base = code - code % 2
    if base == COLUMN_STRING:
        texts = [as_text(v).encode() for v in values if v is not None]
        pays, entries = dictionary_pays(texts)
        lengths = lambda ts: b"".join(varint(len(t)) for t in ts)
        if pays:
            place = {t: i for i, t in enumerate(entries)}
            out.append(_stream(LENGTH, LENGTH_DICTIONARY, LOGICAL_NONE, PHYSICAL_VARINT, len(entries), lengths(entries)))
            out.append(_stream(DATA, DATA_SINGLE, LOGICAL_NONE, PHYSICAL_NONE, len(entries), b"".join(entries)))
            out.append(_stream(OFFSET, OFFSET_STRING, LOGICAL_NONE, PHYSICAL_VARINT, len(texts), b"".join(varint(place[t]) for t in texts)))
        else:
            out.append(_stream(LENGTH, LENGTH_BINARY, LOGICAL_NONE, PHYSICAL_VARINT, len(texts), lengths(texts)))
            out.append(_stream(DATA, DATA_NONE, LOGICAL_NONE, PHYSICAL_NONE, len(texts), b"".join(texts)))
        return varint(len(out)) + b"".join(out)
    there = [v for v in values if v is not None]
    if base == COLUMN_INT:
        out.append(_stream(DATA, DATA_NONE, LOGICAL_NONE, PHYSICAL_VARINT, len(there), b"".join(varint(zigzag(int(v))) for v in there)))
    elif base == COLUMN_DOUBLE:
        out.append(_stream(DATA, DATA_NONE, LOGICAL_NONE, PHYSICAL_NONE, len(there), struct.pack(f"<{len(there)}d", *map(float, there))))
    else:
        bits = bytearray((len(there) + 7) // 8)
        for i, v in enumerate(there):
            bits[i >> 3] |= int(v) << (i & 7)
        out.append(_stream(DATA, DATA_NONE, LOGICAL_NONE, PHYSICAL_NONE, len(there), bytes(bits)))
    return b"".join(out)


def _open(part, base: int):
    part = [(_whole(x), _whole(y)) for x, y in part]
    return part[:-1] if base == POLYGON and len(part) > 1 and part[0] == part[-1] else part


def encode_mlt_layer(name: str, names: list[str], features) -> bytes:
    if not features:
        return b""
    columns = [[f[2][i] for f in features] for i in range(len(names))]
    codes = [column_type(c) for c in columns]
    out = [varint(len(name.encode())), name.encode(), varint(EXTENT), varint(2 + len(names)), bytes((COLUMN_ID, COLUMN_GEOMETRY))]
    for code, key in zip(codes, names):
        out += [bytes((code,)), varint(len(key.encode())), key.encode()]
    ids = [(f[0] or 0) & 0xFFFFFFFFFFFFFFFF for f in features]
    out.append(_stream(DATA, DATA_NONE, LOGICAL_DELTA, PHYSICAL_VARINT, len(ids), b"".join(varint((b - a) & 0xFFFFFFFFFFFFFFFF) for a, b in zip([0, *ids], ids))))
    kinds = [GEOMETRY_CODES[f[1][0]] for f in features]
    geometries, parts, rings, vertices = [], [], [], []
    for _, (kind, members), _ in features:
        base = (kind - 1) % 3 + 1
        if kind > POLYGON:
            geometries.append(len(members))
        for m in members:
            if base == POLYGON:
                parts.append(len(m))
            for p in m:
                p = _open(p, base)
                if base == LINE:
                    parts.append(len(p))
                elif base == POLYGON:
                    rings.append(len(p))
                vertices += p
    streams = [_counts(LENGTH_BINARY, kinds)]
    streams += [_counts(sub, v) for sub, v in ((LENGTH_GEOMETRIES, geometries), (LENGTH_PARTS, parts), (LENGTH_RINGS, rings)) if v]
    if vertices:
        steps = [varint(zigzag(b[k] - a[k])) for a, b in zip([(0, 0), *vertices], vertices) for k in (0, 1)]
        streams.append(_stream(DATA, DATA_VERTEX, LOGICAL_COMPONENT_DELTA, PHYSICAL_VARINT, len(steps), b"".join(steps)))
    out += [varint(len(streams)), *streams]
    out += [_column(code, c) for code, c in zip(codes, columns)]
    payload = varint(1) + b"".join(out)
    return varint(len(payload)) + payload


def encode_mlt(layers) -> bytes:
    """Layers of a tile, one after another; features and layers without geometry are left out."""
    return b"".join(encode_mlt_layer(name, names, [f for f in features if f[1][1]]) for name, names, features in layers)


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def varint(self) -> int:
        v, self.at = read_varint(self.data, self.at)
        return v

    def take(self, n: int) -> bytes:
        self.at += n
        return self.data[self.at - n : self.at]

    def stream(self):
        """(type, subtype, logical, numbers or bytes, count)"""
        a, b = self.take(2)
        kind, sub, logical, physical = a >> 4, a & 15, b >> 5, b & 3
        n, size = self.varint(), self.varint()
        total = n
        if logical == LOGICAL_RLE and physical == PHYSICAL_VARINT:
            self.varint(), (total := self.varint())
        body = self.take(size)
        if kind == PRESENT:
            return kind, sub, logical, byte_unrle(body, (n + 7) // 8), n
        if physical == PHYSICAL_NONE:
            return kind, sub, logical, body, n
        values = _packed(body)
        if logical == LOGICAL_RLE:
            half = len(values) // 2
            values = [v for c, v in zip(values[:half], values[half:]) for _ in range(c)]
        return kind, sub, logical, values, total


def decode_mlt(data: bytes) -> list[dict]:
    out, top = [], _Reader(data)
    while top.at < len(data):
        r = _Reader(top.take(top.varint()))
        r.varint()
        layer = {"name": r.take(r.varint()).decode(), "extent": r.varint(), "features": []}
        codes, names = [], []
        for _ in range(r.varint()):
            code = r.take(1)[0]
            codes.append(code)
            if code > COLUMN_GEOMETRY:
                names.append(r.take(r.varint()).decode())
        ids, last = [], 0
        layer["id_steps"] = r.stream()[3]
        for d in layer["id_steps"]:
            last = (last + d) & 0xFFFFFFFFFFFFFFFF
            ids.append(last)
        found = {}
        for _ in range(r.varint()):
            kind, sub, _, values, _ = r.stream()
            found[(kind, sub)] = iter(values)
        x = y = 0
        vertices, geometries = found.get((DATA, DATA_VERTEX), iter(())), found.get((LENGTH, LENGTH_GEOMETRIES))
        parts, rings = found.get((LENGTH, LENGTH_PARTS)), found.get((LENGTH, LENGTH_RINGS))

        def run(n):
            nonlocal x, y
            points = []
            for _ in range(n):
                x, y = x + unzigzag(next(vertices)), y + unzigzag(next(vertices))
                points.append((x, y))
            return points

        shapes = []
        for code in found[(LENGTH, LENGTH_BINARY)]:
            base = code % 3
            count = next(geometries) if code > 2 else 1
            own = []
            for _ in range(count):
                own += [run(1)] if base == 0 else [run(next(parts))] if base == 1 else [run(next(rings)) for _ in range(next(parts))]
            shapes.append((base + 1, own))
        columns, layer["columns"] = [], []
        for code in codes[2:]:
            base, present = code - code % 2, None
            streams = [r.stream() for _ in range(r.varint())] if base == COLUMN_STRING else [r.stream()]
            if base != COLUMN_STRING and streams[0][0] == PRESENT:
                streams.append(r.stream())
            if streams[0][0] == PRESENT:
                bits, n = streams.pop(0)[3:]
                present = [bits[i >> 3] >> (i & 7) & 1 for i in range(n)]
            layer["columns"].append({"type": code, "streams": [(kind, sub, n) for kind, sub, _, _, n in streams]})
            if base == COLUMN_STRING:
                cut, texts = streams[1][3], []
                for n in streams[0][3]:
                    texts.append(cut[:n].decode())
                    cut = cut[n:]
                values = [texts[i] for i in streams[2][3]] if len(streams) == 3 else texts
            elif base == COLUMN_INT:
                values = list(map(unzigzag, streams[0][3]))
            elif base == COLUMN_DOUBLE:
                values = list(struct.unpack(f"<{streams[0][4]}d", streams[0][3]))
            else:
                values = [bool(streams[0][3][i >> 3] >> (i & 7) & 1) for i in range(streams[0][4])]
            it = iter(values)
            columns.append(values if present is None else [next(it) if p else None for p in present])
        for i, (kind, own) in enumerate(shapes):
            props = {k: c[i] for k, c in zip(names, columns) if c[i] is not None}
            layer["features"].append({"id": ids[i], "kind": kind, "parts": own, "properties": props})
        out.append(layer)
    return out
