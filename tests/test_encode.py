import pytest

from tilewright.operators import encode as e

BOX = [(0, 0), (0, 10), (10, 10), (10, 0), (0, 0)]
GEOMETRIES = [
    (1, [[[(5, 6)]]]),
    (4, [[[(1, 2)]], [[(3, 4)]]]),
    (2, [[[(0, 0), (5, 5), (9, 1)]]]),
    (5, [[[(0, 0), (5, 5)]], [[(7, 7), (8, 8), (9, 7)]]]),
    (3, [[BOX, [(2, 2), (4, 2), (4, 4), (2, 2)]]]),
    (6, [[BOX], [[(20, 20), (20, 30), (30, 30), (20, 20)]]]),
]
NAMES = ["s", "i", "d", "b", "n"]
VALUES = [("x", 1, 0.5, True, None), ("y", -7, 2.0, False, None), (None, None, None, None, None), ("x", 2**40, -1.5, True, None), ("é", 0, 1e300, None, None), ("x", -(2**62), 0.0, False, None)]
FEATURES = [(i * 3 + 1, g, v) for i, (g, v) in enumerate(zip(GEOMETRIES, VALUES))]


def properties(v):
    return {k: x for k, x in zip(NAMES, v) if x is not None}


def test_mvt_round_trip():
    layers = e.decode_mvt(e.encode_mvt([("one", NAMES, FEATURES), ("empty", NAMES, [])]))
    assert [x["name"] for x in layers] == ["one"] and layers[0]["extent"] == 4096 and layers[0]["version"] == 2
    for f, (fid, g, v) in zip(layers[0]["features"], FEATURES, strict=True):
        assert (f["id"], f["kind"]) == (fid, (g[0] - 1) % 3 + 1)
        assert f["properties"] == properties(v)
        flat = [p for m in g[1] for p in m]
        assert f["parts"] == (flat if g[0] != 4 else [[(1, 2)], [(3, 4)]])


def test_mvt_commands():
    assert e.commands((1, [[[(25, 17)]]])) == [9, 50, 34]
    assert e.commands((2, [[[(2, 2), (2, 10), (10, 10)]]])) == [9, 4, 4, 18, 0, 16, 16, 0]
    assert e.commands((3, [[[(3, 6), (8, 12), (20, 34), (3, 6)]]])) == [9, 6, 12, 18, 10, 12, 24, 44, 15]
    assert e.commands((2, [[[(1, 1), (1, 1)]]])) == [] and e.commands((3, [[[(1, 1), (2, 2), (1, 1)]]])) == []
    # a part that cannot be drawn does not move the cursor
    assert e._parts(e.commands((5, [[[(9, 9), (9, 9)]], [[(1, 1), (2, 2)]]]))) == [[(1, 1), (2, 2)]]


def test_values_of_equal_print_stay_apart():
    f = [(1, GEOMETRIES[0], ("1",)), (2, GEOMETRIES[0], (1,)), (3, GEOMETRIES[0], (1.0,)), (4, GEOMETRIES[0], (True,))]
    found = [x["properties"]["v"] for x in e.decode_mvt(e.encode_mvt([("l", ["v"], f)]))[0]["features"]]
    assert [type(v) for v in found] == [str, int, float, bool]


@pytest.mark.parametrize("chosen", [FEATURES, FEATURES[:1] * 40, FEATURES[2:3], FEATURES[4:]])
def test_mlt_round_trip(chosen):
    layers = e.decode_mlt(e.encode_mlt([("one", NAMES, chosen), ("two", [], chosen[:2]), ("none", NAMES, [])]))
    assert [x["name"] for x in layers] == ["one", "two"]
    for f, (fid, g, v) in zip(layers[0]["features"], chosen, strict=True):
        assert f["id"] == fid and f["properties"] == properties(v)
        flat = [p[:-1] if (g[0] - 1) % 3 == 2 else p for m in g[1] for p in m]
        assert f["parts"] == flat


@pytest.mark.parametrize("data,want", [(b"\x05" * 10, [7, 5]), (b"\x05" * 3, [0, 5]), (b"\x01\x02", [254, 1, 2]), (b"", [])])
def test_byte_rle(data, want):
    assert list(e.byte_rle(data)) == want


def test_byte_rle_long():
    assert e.byte_rle(b"\x07" * 130)[0] == 127
    for data in (bytes(range(256)) * 3, b"\x00" * 1000, b"aab" * 99 + b"zzzz"):
        assert e.byte_unrle(e.byte_rle(data), len(data)) == data


@pytest.mark.parametrize("values,want", [([1] * 5, 1), ([1, 2, 3], 3), ([1, 1, 2, 2, 3, 3], 3), ([], 0)])
def test_run_count(values, want):
    assert e.run_count(values) == want


def test_column_types_and_mixed_columns():
    assert e.column_type([1, 2]) == 20 and e.column_type([1, None]) == 21 and e.column_type([1, 2.0]) == 26
    assert e.column_type(["a", 1]) == 28 and e.column_type([None]) == 29 and e.column_type([True]) == 10
    point = (1, [[[(0, 0)]]])
    f = [(1, point, ("31-33",)), (2, point, (5112,)), (3, point, (None,))]
    found = e.decode_mlt(e.encode_mlt([("l", ["v"], f)]))[0]["features"]
    assert [x["properties"].get("v") for x in found] == ["31-33", "5112", None]


def test_dictionary_rule():
    assert e.dictionary_pays([b"aaaaaaaa", b"bbbbbbbb"] * 10)[0]
    assert not e.dictionary_pays([b"a", b"b", b"c"])[0] and not e.dictionary_pays([b"a", b"a"])[0] and not e.dictionary_pays([])[0]


def test_mlt_is_smaller_on_polygons():
    rows = [(i, (3, [[[(i, i), (i, i + 9), (i + 9, i + 9), (i + 9, i), (i, i)]]]), (f"category {i % 3}", i, i / 7)) for i in range(300)]
    assert len(e.encode_mlt([("l", ["c", "i", "d"], rows)])) < len(e.encode_mvt([("l", ["c", "i", "d"], rows)]))
