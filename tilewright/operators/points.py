"""Vector tiles of layers of single points, encoded for a whole batch of tiles at once.

The bytes are those of ``encode_mvt``: what differs from feature to feature is laid out as a matrix of bytes, a row a feature, of which a mask picks
the bytes in use; value indexes by first appearance come from one sort of (tile, value) pairs. Python runs once a tile and once a distinct value.

Large tiles are made by pieces: ``MvtPoints`` and ``MltPoints`` take rows as they come and hold the bytes made so far and the dictionary of the layer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tilewright.operators.encode import (
    COLUMN_BOOL, COLUMN_DOUBLE, COLUMN_GEOMETRY, COLUMN_ID, COLUMN_INT, COLUMN_STRING, DATA, DATA_NONE, DATA_SINGLE, DATA_VERTEX, EXTENT, LENGTH, LENGTH_BINARY, LENGTH_DICTIONARY, LOGICAL_COMPONENT_DELTA, LOGICAL_DELTA, LOGICAL_NONE,
    LOGICAL_RLE, OFFSET, OFFSET_STRING, PHYSICAL_NONE, PHYSICAL_VARINT, PRESENT, _counts, _field, _stream, _value, byte_rle, varint,
)

Block = tuple[np.ndarray, np.ndarray]


def _varints(v: np.ndarray) -> Block:
    """Bytes (a row a number) and how many of them count."""
    v = v.astype(np.uint64)
    wide = max(1, (int(v.max(initial=0)).bit_length() + 6) // 7)
    length = np.ones(len(v), np.int64)
    out = np.empty((len(v), wide), np.uint8)
    for k in range(wide):
        rest = v >> np.uint64(7 * k)
        if k:
            length += rest > 0
        out[:, k] = (rest & np.uint64(127)) | ((rest > np.uint64(127)).astype(np.uint64) << np.uint64(7))
    return out, length


def _constant(n: int, data: bytes, there: np.ndarray | None = None) -> Block:
    length = np.full(n, len(data), np.int64)
    return np.broadcast_to(np.frombuffer(data, np.uint8), (n, len(data))), length if there is None else length * there


def _joined(n: int, blocks: list[Block]) -> tuple[bytes, np.ndarray]:
    """Rows put together, and where each ends."""
    wide = sum(b.shape[1] for b, _ in blocks)
    body, used, at = np.zeros((n, wide), np.uint8), np.zeros((n, wide), bool), 0
    for data, length in blocks:
        w = data.shape[1]
        body[:, at : at + w] = data
        used[:, at : at + w] = np.arange(w) < length[:, None]
        at += w
    return body[used].tobytes(), np.cumsum(used.sum(axis=1))


def _zigzag(v: np.ndarray) -> np.ndarray:
    return ((v << 1) ^ (v >> 63)).view(np.uint64)


def _codes(columns: list[pa.Array]) -> tuple[np.ndarray, list[bytes]]:
    """A code for each cell (-1 for null), equal where bytes of the value are, and those bytes by code."""
    seen: dict[bytes, int] = {}
    out = np.empty((len(columns[0]), len(columns)), np.int64)
    for j, column in enumerate(columns):
        coded = column.dictionary_encode()
        places = np.array([seen.setdefault(_value(v), len(seen)) for v in coded.dictionary.to_pylist()] + [-1], np.int64)
        out[:, j] = places[coded.indices.fill_null(len(places) - 1).to_numpy(zero_copy_only=False)]
    return out, list(seen)


def point_layer(name: str, names: list[str], tile: np.ndarray, fid: pa.Array | None, px: np.ndarray, py: np.ndarray, columns: list[pa.Array]):
    """``(tile, bytes)`` of one layer; rows come in order of ``tile``, a number each."""
    n, m = len(tile), len(columns)
    body, at, starts, keys, values = _features(names, tile, fid, px, py, columns)
    head, tail, named = _frame(name, names)
    for k, t in enumerate(tile[starts].tolist()):
        yield t, _field(3, b"".join((head, body[at[k] : at[k + 1]], *(named[j] for j in keys[k]), *values[k], tail)))


def _frame(name: str, names: list[str]) -> tuple[bytes, bytes, list[bytes]]:
    """What stands before and after the features of a layer, and its names as keys."""
    return _field(1, name.encode()), varint(5 << 3) + varint(EXTENT) + varint(15 << 3) + varint(2), [_field(3, k.encode()) for k in names]


def _features(names, tile, fid, px, py, columns, known: tuple[dict, list] | None = None):
    """Bytes of the features, where those of each tile start, the first row of each tile, and its keys (places of ``names``) and values as written. With
    ``known``, the values (bytes to index) and keys that a layer has by now, the rows are of that one layer: only what is new comes back, and is added."""
    n, m = len(tile), len(columns)
    starts = np.flatnonzero(np.diff(tile, prepend=tile[0] - 1))
    nth = np.cumsum(np.diff(tile, prepend=tile[0]) != 0)
    blocks: list[Block] = []
    if fid is not None:
        there = ~np.asarray(fid.is_null())
        data, length = _varints(np.asarray(fid.fill_null(0)).astype(np.int64).view(np.uint64))
        blocks += [_constant(n, b"\x08", there), (data, length * there)]
    keys: list[list[int]] = [[]] * len(starts)
    values: list[list[bytes]] = [[]] * len(starts)
    if m:
        codes, raw = _codes(columns)
        filled = codes >= 0
        spots = np.flatnonzero(filled.ravel())
        # values: by tile, in order of first appearance
        pairs = (nth[:, None] * max(1, len(raw)) + codes).ravel()[spots]
        unique, first, inverse = np.unique(pairs, return_index=True, return_inverse=True)
        order = np.argsort(first, kind="stable")
        home = unique[order] // max(1, len(raw))
        edges = np.searchsorted(home, np.arange(len(starts) + 1))
        rank = np.empty(len(unique), np.int64)
        rank[order] = np.arange(len(unique)) - edges[home]
        written = [_field(4, b) for b in raw]
        called = (unique[order] % max(1, len(raw))).tolist()
        if known:
            new = [c for c in called if raw[c] not in known[0]]
            for c in new:
                known[0][raw[c]] = len(known[0])
            values = [[written[c] for c in new]]
            rank[order] = [known[0][raw[c]] for c in called]
        else:
            values = [[written[c] for c in called[a:b]] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
        index = np.zeros(n * m, np.int64)
        index[spots] = rank[inverse]
        index = index.reshape(n, m)
        # keys: columns of a tile by the cell in which they first appear
        place = np.where(filled, np.arange(n * m).reshape(n, m), n * m)
        seen = np.minimum.reduceat(place, starts, axis=0)
        if known:
            seen[0] = [known[1].index(j) - m if j in known[1] else s for j, s in enumerate(seen[0].tolist())]
        sequence = np.argsort(seen, axis=1, kind="stable")
        key = np.empty_like(sequence)
        np.put_along_axis(key, sequence, np.broadcast_to(np.arange(m), sequence.shape), axis=1)
        counts = (seen < n * m).sum(axis=1).tolist()
        keys = [row[:c] for row, c in zip(sequence.tolist(), counts)]
        if known:
            keys = [keys[0][len(known[1]) :]]
            known[1].extend(keys[0])
        tags: list[Block] = []
        size = np.zeros(n, np.int64)
        for j in range(m):
            own = filled[:, j]
            for data, length in (_varints(key[nth, j]), _varints(index[:, j])):
                tags.append((data, length * own))
                size += length * own
        there = size > 0
        data, length = _varints(size)
        blocks += [_constant(n, b"\x12", there), (data, length * there), *tags]
    x, y = _varints(_zigzag(px)), _varints(_zigzag(py))
    blocks += [_constant(n, b"\x18\x01\x22"), _varints(1 + x[1] + y[1]), _constant(n, b"\x09"), x, y]
    total = sum(length for _, length in blocks)
    body, ends = _joined(n, [_constant(n, b"\x12"), _varints(total), *blocks])
    return body, [0, *ends[np.append(starts[1:], n) - 1].tolist()], starts, keys, values


def _size_of(number: int, size: int) -> bytes:
    return varint(number << 3 | 2) + varint(size)


class MvtPoints:
    """One layer of one tile, made by pieces; the bytes of ``point_layer``."""

    def __init__(self, name: str, names: list[str]):
        self.name, self.names = name, names
        self.body: list[bytes] = []
        self.values: list[bytes] = []
        self.known: tuple[dict, list] = ({}, [])

    def add(self, fid: pa.Array | None, px: np.ndarray, py: np.ndarray, columns: list[pa.Array]) -> None:
        if len(px):
            body, _, _, _, (values,) = _features(self.names, np.zeros(len(px), np.int64), fid, px, py, columns, self.known)
            self.body.append(body)
            self.values += values

    def finish(self) -> bytes:
        if not self.body:
            return b""
        head, tail, named = _frame(self.name, self.names)
        parts = [head, *self.body, *(named[j] for j in self.known[1]), *self.values, tail]
        return b"".join((_size_of(3, sum(map(len, parts))), *parts))


def _bytes_of(numbers: np.ndarray) -> bytes:
    return _joined(len(numbers), [_varints(numbers)])[0] if len(numbers) else b""


class _MltColumn:
    """Cells of a column: presence, a bit a cell at the end; what is there as the stream wants it, but texts as indexes of a dictionary."""

    def __init__(self, kind: pa.DataType):
        self.kind, self.n, self.there = kind, 0, 0
        self.present: list[np.ndarray] = []
        self.parts: list = []
        self.entries: dict[str, int] = {}

    def add(self, column: pa.Array) -> None:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        self.n += len(column)
        self.present.append(np.asarray(column.is_valid()).astype(np.uint8))
        own = column.drop_null()
        self.there += len(own)
        if pa.types.is_floating(self.kind):
            self.parts.append(own.cast(pa.float64()).to_numpy(zero_copy_only=False).astype("<f8").tobytes())
        elif pa.types.is_integer(self.kind):
            self.parts.append(_bytes_of(_zigzag(own.cast(pa.int64()).to_numpy(zero_copy_only=False))))
        elif pa.types.is_boolean(self.kind):
            self.parts.append(own.to_numpy(zero_copy_only=False).astype(np.uint8))
        elif len(own):
            coded = own.cast(pa.string()).dictionary_encode()
            places = np.array([self.entries.setdefault(v, len(self.entries)) for v in coded.dictionary.to_pylist()], np.int32)
            self.parts.append(places[coded.indices.to_numpy(zero_copy_only=False)])

    def finish(self) -> tuple[int, bytes]:
        """Type and bytes of the column, as ``column_type`` and ``_column`` make them."""
        nullable = self.there < self.n
        out = []
        if nullable:
            bits = np.packbits(np.concatenate(self.present), bitorder="little").tobytes()
            out.append(_stream(PRESENT, 0, LOGICAL_RLE, PHYSICAL_NONE, self.n, byte_rle(bits)))
        if self.there and pa.types.is_floating(self.kind):
            return COLUMN_DOUBLE + nullable, b"".join((*out, _stream(DATA, DATA_NONE, LOGICAL_NONE, PHYSICAL_NONE, self.there, b"".join(self.parts))))
        if self.there and pa.types.is_integer(self.kind):
            return COLUMN_INT + nullable, b"".join((*out, _stream(DATA, DATA_NONE, LOGICAL_NONE, PHYSICAL_VARINT, self.there, b"".join(self.parts))))
        if self.there and pa.types.is_boolean(self.kind):
            bits = np.packbits(np.concatenate(self.parts), bitorder="little").tobytes()
            return COLUMN_BOOL + nullable, b"".join((*out, _stream(DATA, DATA_NONE, LOGICAL_NONE, PHYSICAL_NONE, self.there, bits)))
        if not self.there:
            self.parts = []  # a column of nulls is text, whatever its kind
        entries = [v.encode() for v in self.entries]
        codes = np.concatenate(self.parts) if self.there else np.zeros(0, np.int32)
        length = np.array([len(e) for e in entries], np.int64)
        cost = _varints(length)[1] + length if entries else length
        plain = int((np.bincount(codes, minlength=len(entries)) * cost).sum()) if entries else 0
        indexes = 0 if not entries else int((_varints(np.arange(len(entries)))[1] * np.bincount(codes, minlength=len(entries))).sum())
        if len(entries) < self.there and int(cost.sum()) + indexes + 12 < plain + 8:
            out.append(_stream(LENGTH, LENGTH_DICTIONARY, LOGICAL_NONE, PHYSICAL_VARINT, len(entries), _bytes_of(length)))
            out.append(_stream(DATA, DATA_SINGLE, LOGICAL_NONE, PHYSICAL_NONE, len(entries), b"".join(entries)))
            out.append(_stream(OFFSET, OFFSET_STRING, LOGICAL_NONE, PHYSICAL_VARINT, self.there, b"".join(_bytes_of(p) for p in self.parts)))
        else:
            out.append(_stream(LENGTH, LENGTH_BINARY, LOGICAL_NONE, PHYSICAL_VARINT, self.there, b"".join(_bytes_of(length[p]) for p in self.parts)))
            out.append(_stream(DATA, DATA_NONE, LOGICAL_NONE, PHYSICAL_NONE, self.there, b"".join(entries[k] for p in self.parts for k in p.tolist())))
        return COLUMN_STRING + nullable, varint(len(out)) + b"".join(out)


class MltPoints:
    """One layer of single points of one tile, made by pieces; the bytes of ``encode_mlt``."""

    def __init__(self, name: str, names: list[str]):
        self.name, self.names = name, names
        self.n, self.last = 0, np.zeros(3, np.int64)
        self.columns: list[_MltColumn] = []
        self.ids: list[bytes] = []
        self.steps: list[bytes] = []

    def add(self, fid: pa.Array | None, px: np.ndarray, py: np.ndarray, columns: list[pa.Array]) -> None:
        if not len(px):
            return
        own = np.zeros(len(px), np.int64) if fid is None else np.asarray(fid.fill_null(0)).astype(np.int64)
        step = [np.diff(v, prepend=v.dtype.type(a)) for v, a in zip((own, px.astype(np.int64), py.astype(np.int64)), self.last)]
        self.last = np.array([own[-1], px[-1], py[-1]], np.int64)
        self.ids.append(_bytes_of(step[0].view(np.uint64)))
        self.steps.append(_bytes_of(_zigzag(np.stack(step[1:], axis=1).ravel())))
        self.n += len(px)
        self.columns = self.columns or [_MltColumn(c.type) for c in columns]
        for column, cells in zip(self.columns, columns):
            column.add(cells)

    def finish(self) -> bytes:
        if not self.n:
            return b""
        name = self.name.encode()
        columns = [c.finish() for c in self.columns]
        out = [varint(1), varint(len(name)), name, varint(EXTENT), varint(2 + len(self.names)), bytes((COLUMN_ID, COLUMN_GEOMETRY))]
        for (code, _), key in zip(columns, self.names):
            out += [bytes((code,)), varint(len(key.encode())), key.encode()]
        out.append(_stream(DATA, DATA_NONE, LOGICAL_DELTA, PHYSICAL_VARINT, self.n, b"".join(self.ids)))
        kinds = _counts(LENGTH_BINARY, [0] * self.n) if self.n < 3 else _stream(LENGTH, LENGTH_BINARY, LOGICAL_RLE, PHYSICAL_VARINT, 2, varint(self.n) + varint(0), varint(1) + varint(self.n))
        out += [varint(2), kinds, _stream(DATA, DATA_VERTEX, LOGICAL_COMPONENT_DELTA, PHYSICAL_VARINT, 2 * self.n, b"".join(self.steps))]
        out += [body for _, body in columns]
        return b"".join((varint(sum(map(len, out))), *out))
