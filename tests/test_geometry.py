import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tilewright.functions import geometry as g
from tilewright.operators.clip import clip, clip_line, clip_polygon
from tilewright.operators.coalesce import chain_lines, coalesce
from tilewright.operators.simplify import half_away, snap, visvalingam

BOX = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
HOLE = [(1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (2.0, 1.0), (1.0, 1.0)]
SHAPES = [
    (g.POINT, [[[(1.5, -2.0)]]]),
    (g.LINE, [[[(0.0, 0.0), (1.0, 2.0), (3.0, 1.0)]]]),
    (g.POLYGON, [[BOX, HOLE]]),
    (g.MULTIPOINT, [[[(0.0, 1.0)]], [[(2.0, 3.0)]]]),
    (g.MULTILINE, [[[(0.0, 0.0), (1.0, 1.0)]], [[(2.0, 2.0), (3.0, 3.0)]]]),
    (g.MULTIPOLYGON, [[BOX, HOLE], [[(9.0, 9.0), (10.0, 9.0), (10.0, 10.0), (9.0, 9.0)]]]),
]


@pytest.mark.parametrize("shape", SHAPES)
def test_wkb_round_trip(shape):
    assert g.from_wkb(g.to_wkb(shape)) == shape


@pytest.mark.parametrize("data", [None, b"", b"\x01", b"\x01\x07\x00\x00\x00\x00\x00\x00\x00", g.to_wkb(SHAPES[2])[:40]])
def test_broken_wkb_is_none(data):
    assert g.from_wkb(data) is None


def test_z_and_srid_are_dropped():
    import struct

    assert g.from_wkb(struct.pack("<BI3d", 1, 1001, 1, 2, 3)) == (g.POINT, [[[(1.0, 2.0)]]])
    assert g.from_wkb(struct.pack("<BII2d", 1, 0x20000001, 4326, 1, 2)) == (g.POINT, [[[(1.0, 2.0)]]])
    assert g.from_wkb(struct.pack(">BI2d", 0, 1, 1, 2)) == (g.POINT, [[[(1.0, 2.0)]]])


def test_wkt():
    assert g.from_wkt("POINT (1.5 -2)") == SHAPES[0]
    assert g.from_wkt("POLYGON((0 0, 4 0, 4 4, 0 4, 0 0),(1 1,1 2,2 2,2 1,1 1))") == SHAPES[2]
    assert g.from_wkt("MULTIPOLYGON(((0 0,4 0,4 4,0 4,0 0),(1 1,1 2,2 2,2 1,1 1)),((9 9,10 9,10 10,9 9)))") == SHAPES[5]
    assert g.from_wkt("GEOMETRYCOLLECTION EMPTY") is None


def polygon_area(polygons):
    return sum(abs(g.area2(p[0])) - sum(abs(g.area2(h)) for h in p[1:]) for p in polygons) / 2


def test_concave_polygon_falls_apart():
    comb = [(0, 0), (5, 0), (5, 5), (4, 5), (4, 1), (1, 1), (1, 5), (0, 5), (0, 0)]
    parts = clip_polygon([comb], (-1, 2, 6, 6))
    assert len(parts) == 2 and polygon_area(parts) == pytest.approx(6.0)


def test_hole_over_the_border():
    parts = clip_polygon([BOX, HOLE], (1.5, -1, 9, 9))
    assert len(parts) == 1 and len(parts[0]) == 1
    assert polygon_area(parts) == pytest.approx(10 - 0.5)
    assert polygon_area(clip_polygon([BOX, HOLE], (0.5, 0.5, 3, 3))) == pytest.approx(6.25 - 1)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_clipped_area_matches_sampling(seed):
    rng = random.Random(seed)
    n = rng.randint(3, 14)
    ring = [(math.cos(2 * math.pi * k / n) * (r := rng.uniform(1, 4)), math.sin(2 * math.pi * k / n) * r) for k in range(n)]
    box = (rng.uniform(-3, 0), rng.uniform(-3, 0), rng.uniform(0.1, 3), rng.uniform(0.1, 3))
    parts = clip_polygon([[*ring, ring[0]]], box)
    from tilewright.operators.clip import _inside

    hits = total = 0
    for i in range(40):
        for j in range(40):
            p = (box[0] + (i + 0.5) / 40 * (box[2] - box[0]), box[1] + (j + 0.5) / 40 * (box[3] - box[1]))
            hits += _inside(p, ring)
            total += 1
    area = (box[2] - box[0]) * (box[3] - box[1])
    assert polygon_area(parts) == pytest.approx(area * hits / total, abs=area * 0.05)
    for p in parts:
        for x, y in p[0]:
            assert box[0] - 1e-9 <= x <= box[2] + 1e-9 and box[1] - 1e-9 <= y <= box[3] + 1e-9


def test_line_leaves_and_returns():
    pieces = clip_line([(0, 0), (10, 0), (10, 5), (0, 5)], (1, -1, 8, 9))
    assert pieces == [[(1, 0), (8, 0)], [(8, 5), (1, 5)]]
    assert clip((g.LINE, [[[(0.0, 0.0), (10.0, 0.0), (10.0, 5.0), (0.0, 5.0)]]]), (1, -1, 8, 9))[0] == g.MULTILINE
    assert clip_line([(0, 0), (1, 1)], (5, 5, 6, 6)) == []


def test_points_on_the_border_stay():
    assert clip((g.POINT, [[[(1.0, 1.0)]]]), (1, 1, 2, 2)) is not None
    assert clip((g.MULTIPOINT, [[[(1.0, 1.0)]], [[(5.0, 5.0)]]]), (1, 1, 2, 2)) == (g.MULTIPOINT, [[[(1.0, 1.0)]]])


def brute_visvalingam(line, tolerance):
    line = list(line)
    while len(line) > 2:
        areas = [abs((b[0] - a[0]) * (c[1] - a[1]) - (c[0] - a[0]) * (b[1] - a[1])) / 2 for a, b, c in zip(line, line[1:], line[2:])]
        k = min(range(len(areas)), key=areas.__getitem__)
        if areas[k] > tolerance:
            break
        del line[k + 1]
    return line


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(-9, 9), st.floats(-9, 9)), min_size=2, max_size=25), st.floats(0.01, 20))
def test_visvalingam(line, tolerance):
    found, want = visvalingam(line, tolerance), brute_visvalingam(line, tolerance)
    assert found[0] == line[0] and found[-1] == line[-1]
    assert len(found) == len(want) or len(set(line)) < len(line)


def test_snapping():
    assert [half_away(v) for v in (-0.5, 0.5, 2.5, -2.5, 0.49)] == [-1, 1, 3, -3, 0]
    assert snap((g.LINE, [[[(0.1, 0.1), (0.2, 0.3), (5.0, 5.0)]]])) == (g.LINE, [[[(0, 0), (5, 5)]]])
    tiny = (g.LINE, [[[(0.1, 0.1), (0.2, 0.3)]]])
    assert snap(tiny) == tiny
    assert snap((g.POLYGON, [[BOX, [(1.0, 1.0), (1.1, 1.1), (1.2, 1.0), (1.0, 1.0)]]]))[1][0] == [[(int(x), int(y)) for x, y in BOX]]


def test_chains():
    lines = [[(0, 0), (1, 0)], [(2, 0), (1, 0)], [(5, 5), (6, 6)], [(0, 0), (0, 1)]]
    assert chain_lines(lines) == [[(0, 1), (0, 0), (1, 0), (2, 0)], [(5, 5), (6, 6)]]


def test_coalesce_groups():
    point, line, box = (1, [[[(1, 1)]]]), (2, [[[(0, 0), (1, 0)]]]), (3, [[BOX]])
    features = [(9, box, ("a",)), (1, line, ("r",)), (2, point, ("a",)), (3, (2, [[[(1, 0), (2, 0)]]]), ("r",)), (4, box, ("a",)), (5, line, ("s",))]
    merged = coalesce(features)
    assert [f[0] for f in merged] == [2, 1, 5, 9]
    assert merged[1][1] == (2, [[[(0, 0), (1, 0), (2, 0)]]]) and merged[3][1][0] == 6
    assert coalesce(features[:1]) == features[:1]
    assert len(coalesce([(1, point, (1,)), (2, line, (True,)), (3, line, (1,))])) == 3
