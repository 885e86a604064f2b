"""Reading layers of single points back from the bytes of a tile, by columns and in pieces.

Features of a piece are read in lockstep: each numpy step takes the next number of all of them. What is held beside the bytes is the dictionary of a layer
and one piece, whatever the number of features.
"""

from __future__ import annotations

import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tilewright.operators.encode import (
    COLUMN_DOUBLE, COLUMN_GEOMETRY, COLUMN_INT, COLUMN_STRING, DATA, DATA_VERTEX, LENGTH, LENGTH_BINARY, LOGICAL_RLE, PHYSICAL_VARINT, PRESENT, byte_unrle, feature_of, read_varint, unzigzag,
)

#: Features that are read, and rows that are handed on, at once.
PIECE = 1 << 14
_KINDS = {pa.string(): str, pa.float64(): float, pa.int64(): int, pa.bool_(): bool}


def _read(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The varint at each place, and the place after it."""
    b = buf[at]
    v, at = (b & 127).astype(np.uint64), at + 1
    left = np.flatnonzero(b > 127)
    shift = 7
    while len(left):
        b = buf[at[left]]
        v[left] |= (b & 127).astype(np.uint64) << np.uint64(shift)
        at[left] += 1
        left = left[b > 127]
        shift += 7
    return v, at


def _unzigzag(v: np.ndarray) -> np.ndarray:
    return (v >> np.uint64(1)).view(np.int64) ^ -(v & np.uint64(1)).view(np.int64)


# ---- Mapbox Vector Tiles -------------------------------------------------------------------------------------------------


def _mvt_value(data: bytes, at: int, end: int):
    v = None
    while at < end:
        key, at = read_varint(data, at)
        number, wire = key >> 3, key & 7
        if wire == 0:
            x, at = read_varint(data, at)
            v = {4: lambda x: x - (1 << 64) if x >> 63 else x, 5: int, 6: unzigzag, 7: bool}[number](x)
        elif wire == 1:
            v, at = struct.unpack_from("<d", data, at)[0], at + 8
        elif wire == 5:
            v, at = struct.unpack_from("<f", data, at)[0], at + 4
        else:
            n, at = read_varint(data, at)
            v, at = data[at : at + n].decode(), at + n
    return v


class MvtLayer:
    """Where the features of a layer lie, and its keys and values."""

    def __init__(self, data: bytes, at: int, end: int):
        self.data, self.name, self.keys, self.values = data, "", [], []
        self.starts, self.ends = array("q"), array("q")
        start, stop = self.starts.append, self.ends.append
        while at < end:
            key = data[at]
            if key == 0x12:
                n = data[at + 1]
                if n < 128:
                    at += 2
                else:
                    n, at = read_varint(data, at + 1)
                start(at)
                at += n
                stop(at)
                continue
            key, at = read_varint(data, at)
            n, at = read_varint(data, at)
            if key & 7 == 2:
                if key >> 3 == 1:
                    self.name = data[at : at + n].decode()
                elif key >> 3 == 3:
                    self.keys.append(data[at : at + n].decode())
                elif key >> 3 == 4:
                    self.values.append(_mvt_value(data, at, at + n))
                at += n

    def features(self) -> Iterator[dict]:
        """Features of any kind, one by one, as ``decode_mvt`` gives them."""
        for a, b in zip(self.starts, self.ends):
            yield feature_of(self.data[a:b], self.keys, self.values)

    def points(self, wanted: dict[str, pa.DataType]) -> Iterator[dict]:
        """Pieces: ``id``, ``command``, ``zx``, ``zy`` (the numbers of the command stream), ``x``, ``y`` and, by name, ``wanted`` properties."""
        buf = np.frombuffer(self.data, np.uint8)
        typed = {t: pa.array([v if type(v) is _KINDS[t] else None for v in self.values], t) for t in set(wanted.values())}
        place = {k: i for i, k in enumerate(self.keys)}
        starts, ends = np.frombuffer(self.starts, np.int64), np.frombuffer(self.ends, np.int64)
        for first in range(0, len(starts), PIECE):
            at, end = starts[first : first + PIECE].copy(), ends[first : first + PIECE]
            n = len(at)
            ids, known, kinds = np.zeros(n, np.uint64), np.zeros(n, bool), np.zeros(n, np.uint64)
            tags, shape = np.zeros((2, n), np.int64), np.zeros((2, n), np.int64)
            while len(live := np.flatnonzero(at < end)):
                key, after = _read(buf, at[live])
                v, after = _read(buf, after)
                number = key >> np.uint64(3)
                ids[live[number == 1]], known[live[number == 1]] = v[number == 1], True
                kinds[live[number == 3]] = v[number == 3]
                size = np.where(key & np.uint64(7) == 2, v, 0).astype(np.int64)
                for k, span in ((2, tags), (4, shape)):
                    own = number == k
                    span[:, live[own]] = after[own], after[own] + size[own]
                at[live] = after + size
            command, go = _read(buf, shape[0])
            if (kinds != 1).any() or (command != 9).any():
                raise ValueError(f"layer {self.name} holds more than single points")
            zx, go = _read(buf, go)
            zy, _ = _read(buf, go)
            index = np.full((len(self.keys), n), -1, np.int64)
            at, end = tags
            while len(live := np.flatnonzero(at < end)):
                k, after = _read(buf, at[live])
                v, after = _read(buf, after)
                index[k.astype(np.int64), live] = v.astype(np.int64)
                at[live] = after
            out = {"id": pa.array(ids.view(np.int64), mask=~known), "command": command.view(np.int64), "zx": zx.view(np.int64), "zy": zy.view(np.int64), "x": _unzigzag(zx), "y": _unzigzag(zy)}
            for name, kind in wanted.items():
                mine = index[place[name]] if name in place else np.full(n, -1, np.int64)
                out[name] = typed[kind].take(pa.array(mine, mask=mine < 0))
            yield out


def mvt_layers(data: bytes) -> Iterator[MvtLayer]:
    at = 0
    while at < len(data):
        key, at = read_varint(data, at)
        n, at = read_varint(data, at)
        if key >> 3 == 3:
            yield MvtLayer(data, at, at + n)
        if key & 7 == 2:
            at += n


def mvt_points(data: bytes, wanted: dict[str, pa.DataType]) -> Iterator[dict]:
    for layer in mvt_layers(data):
        yield from layer.points(wanted)


# ---- MapLibre Tiles ------------------------------------------------------------------------------------------------------


def _numbers(body) -> np.ndarray:
    """All varints of a stream, which are at most 10 bytes each."""
    buf = np.frombuffer(body, np.uint8)
    out = []
    at = 0
    while at < len(buf):
        own = buf[at : at + (1 << 18)]
        last = np.flatnonzero(own < 128)
        out.append(_read(own, np.concatenate(([0], last[:-1] + 1)))[0])
        at += int(last[-1]) + 1
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


class MltLayer:
    """Names and types of the columns of a layer, and its streams, unread: (type, subtype, logical, physical, numbers, body)."""

    def __init__(self, data: bytes, at: int):
        def number():
            nonlocal at
            v, at = read_varint(data, at)
            return v

        def stream():
            nonlocal at
            a, b = data[at], data[at + 1]
            at += 2
            n, size = number(), number()
            if b >> 5 == LOGICAL_RLE and b & 3 == PHYSICAL_VARINT:
                number(), number()
            at += size
            return a >> 4, a & 15, b >> 5, b & 3, n, memoryview(data)[at - size : at]

        def text():
            nonlocal at
            n = number()
            at += n
            return data[at - n : at].decode()

        number()
        self.name = text()
        number()
        self.columns = []
        for _ in range(number()):
            code = data[at]
            at += 1
            if code > COLUMN_GEOMETRY:
                self.columns.append({"type": code, "name": text()})
        self.id_stream = stream()
        self.shape = {s[:2]: s for s in (stream() for _ in range(number()))}
        for c in self.columns:
            base = c["type"] - c["type"] % 2
            own = [stream() for _ in range(number())] if base == COLUMN_STRING else [stream()]
            if base != COLUMN_STRING and own[0][0] == PRESENT:
                own.append(stream())
            c["present"] = own.pop(0) if own[0][0] == PRESENT else None
            c["streams"] = own

    def id_steps(self) -> np.ndarray:
        return _numbers(self.id_stream[5]).view(np.int64)

    def values(self, column: dict) -> pa.Array:
        base, streams = column["type"] - column["type"] % 2, column["streams"]
        _, _, _, physical, n, body = streams[0]
        if base == COLUMN_STRING:
            lengths = _numbers(body).astype(np.int64)
            offsets = np.concatenate(([0], np.cumsum(lengths)))
            made = pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(streams[1][5])).cast(pa.string())
            there = made.take(pa.array(_numbers(streams[2][5]).astype(np.int64))) if len(streams) == 3 else made
        elif base == COLUMN_INT:
            there = pa.array(_unzigzag(_numbers(body)))
        elif base == COLUMN_DOUBLE:
            there = pa.array(np.frombuffer(body, "<f8"))
        else:
            there = pa.array(np.unpackbits(np.frombuffer(body, np.uint8), count=n, bitorder="little").astype(bool))
        if column["present"] is None:
            return there
        _, _, _, _, n, body = column["present"]
        bits = np.unpackbits(np.frombuffer(byte_unrle(bytes(body), (n + 7) // 8), np.uint8), count=n, bitorder="little").astype(bool)
        return there.take(pa.array(np.cumsum(bits) - 1, mask=~bits))

    def points(self, wanted: dict[str, pa.DataType]) -> Iterator[dict]:
        ids = np.cumsum(self.id_steps())
        _, _, logical, physical, _, body = self.shape[LENGTH, LENGTH_BINARY]
        kinds = _numbers(body)
        if (kinds[len(kinds) // 2 :] if logical == LOGICAL_RLE else kinds).any():
            raise ValueError(f"layer {self.name} holds more than single points")
        steps = _unzigzag(_numbers(self.shape[DATA, DATA_VERTEX][5]))
        x, y = np.cumsum(steps[::2]), np.cumsum(steps[1::2])
        named = {c["name"]: c for c in self.columns}
        columns = {}
        for name, kind in wanted.items():
            # a column of nulls has the type of texts
            own = self.values(named[name]) if name in named else None
            columns[name] = pa.nulls(len(ids), kind) if own is None or own.null_count == len(ids) else own.cast(kind)
        for a in range(0, len(ids), PIECE):
            b = min(a + PIECE, len(ids))
            yield {"id": pa.array(ids[a:b]), "x": x[a:b], "y": y[a:b], **{k: c.slice(a, b - a) for k, c in columns.items()}}


def mlt_layers(data: bytes) -> Iterator[MltLayer]:
    at = 0
    while at < len(data):
        n, at = read_varint(data, at)
        yield MltLayer(data, at)
        at += n


def mlt_points(data: bytes, wanted: dict[str, pa.DataType]) -> Iterator[dict]:
    for layer in mlt_layers(data):
        yield from layer.points(wanted)
