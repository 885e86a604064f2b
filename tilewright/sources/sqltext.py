"""SQL front door: several statements in one text, and spatial functions."""

from __future__ import annotations

import re
import uuid

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tilewright.functions import crs as projections
from tilewright.functions.geometry import NAMES, POINT, bbox, from_wkb, from_wkt, srid_of, to_wkb, transform, with_srid
from tilewright.plans.store import saved


def split_statements(text: str) -> list[str]:
    """Statements between semicolons. Semicolons in quotes, backquotes and comments don't count; empty statements fall away."""
    out, at, start, n = [], 0, 0, len(text)
    while at < n:
        c = text[at]
        if c in "'\"`":
            at += 1
            while at < n and text[at] != c:
                at += 2 if text[at] == "\\" and c != "`" else 1
        elif text.startswith("--", at):
            at = text.find("\n", at)
            at = n if at < 0 else at
        elif text.startswith("/*", at):
            at = text.find("*/", at)
            at = n if at < 0 else at + 1
        elif c == ";":
            out.append(text[start:at])
            start = at + 1
        at += 1
    out.append(text[start:])
    return [s.strip() for s in out if s.strip()]


# Functions of other engines that read files, and the readers here.
FILE_READERS = {"read_parquet": "parquet", "parquet_scan": "parquet", "read_csv": "csv", "read_csv_auto": "csv", "read_json": "json", "read_json_auto": "json", "st_read": "spatial"}
_READER = re.compile(rf"\b({'|'.join(FILE_READERS)})\s*\(\s*", re.I)
_FROM = re.compile(r"\b(?:FROM|JOIN)\s+(?=')", re.I)
_EXCLUDE = re.compile(r"\*\s*EXCLUDE\s*(?:\(([^()]*)\)|(\w+))", re.I)
_MADE = re.compile(r"CREATE\s+(?:OR\s+REPLACE\s+)?(?:TEMP(?:ORARY)?\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?(`[^`]+`|\"[^\"]+\"|\w+)\s+AS\s+(.*)\Z", re.I | re.S)


def _pieces(text: str) -> list[tuple[bool, str]]:
    """``(is code, part)``: quoted parts and comments are not code."""
    out, at, start, n = [], 0, 0, len(text)
    while at < n:
        end = at
        if text[at] in "'\"`":
            end = at + 1
            while end < n and text[end] != text[at]:
                end += 2 if text[end] == "\\" and text[at] != "`" else 1
            end += 1
        elif text.startswith("--", at):
            end = text.find("\n", at)
            end = n if end < 0 else end
        elif text.startswith("/*", at):
            end = text.find("*/", at)
            end = n if end < 0 else end + 2
        if end > at:
            out += [(True, text[start:at]), (False, text[at:end])]
            at = start = end
        else:
            at += 1
    return [*out, (True, text[start:])]


def _literals(text: str, at: int) -> tuple[list[str], int]:
    """The quoted paths from ``at`` (one, or a list in brackets), and the place behind the closing parenthesis."""
    paths, depth = [], 0
    while at < len(text):
        c = text[at]
        if c == "'":
            end = text.index("'", at + 1)
            if depth == 0 and not paths or depth == 1 and text[:at].rstrip()[-1] in "[,":
                paths.append(text[at + 1 : end])
            at = end
        elif c in "[({":
            depth += 1
        elif c in "])}":
            if c == ")" and depth == 0:
                return paths, at + 1
            depth -= 1
        at += 1
    raise ValueError("a file function is not closed")


def _file_view(spark: SparkSession, kind: str, paths: list[str]) -> str:
    from tilewright.sources.files import read_features

    if not paths:
        raise ValueError("a file function needs a quoted path")
    if kind == "spatial":
        df, geometry, crs = read_features(spark, paths[0])
        df = df.withColumnRenamed(geometry, "geom")
        if crs and crs.startswith("EPSG:") and crs != "EPSG:4326":
            df = df.withColumn("geom", F.call_function("st_setsrid", F.col("geom"), F.lit(int(crs[5:]))))
    elif kind == "csv":
        df = spark.read.csv(paths, header=True, inferSchema=True)
    else:
        df = getattr(spark.read, kind)(*paths) if kind == "parquet" else spark.read.json(paths)
    name = f"__file_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(name)
    return name


def adapted(spark: SparkSession, statement: str) -> str:
    """A statement in Spark's SQL: files that are named in place of tables become views, ``* EXCLUDE`` becomes ``* EXCEPT``, ``//`` becomes ``div``."""
    at = 0
    while True:
        place, found, code_at = None, None, 0
        for code, part in _pieces(statement):
            if code:
                hit = min((m for m in (_READER.search(part, max(0, at - code_at)), _FROM.search(part + ("'" if statement[code_at + len(part) : code_at + len(part) + 1] == "'" else ""), max(0, at - code_at))) if m), key=lambda m: m.start(), default=None)
                if hit:
                    place, found = code_at, hit
                    break
            code_at += len(part)
        if not found:
            break
        start, body = place + found.start(), place + found.end()
        if found.re is _READER:
            paths, end = _literals(statement, body)
            view = _file_view(spark, FILE_READERS[found[1].lower()], paths)
            statement, at = statement[:start] + view + statement[end:], start + len(view)
        else:
            end = statement.index("'", body + 1)
            path = statement[body + 1 : end]
            kind = next((k for suffix, k in ((".parquet", "parquet"), (".csv", "csv"), (".json", "json")) if path.lower().endswith(suffix)), "spatial")
            view = _file_view(spark, kind, [path])
            statement, at = statement[:body] + view + statement[end + 1 :], body + len(view)
    code = lambda part: _EXCLUDE.sub(lambda m: f"* EXCEPT ({m[1] or m[2]})", part).replace("//", " div ")
    return "".join(code(part) if is_code else part for is_code, part in _pieces(statement))


def run_setup(spark: SparkSession, text: str) -> str:
    """Run all statements but the last, which is returned. INSTALL and LOAD, of other engines, are passed over; a table that is created from a
    query is written once and known under its name for the session."""
    statements = split_statements(text)
    if not statements:
        raise ValueError("the query is empty")
    for one in statements[:-1]:
        if one.split(None, 1)[0].upper() in ("INSTALL", "LOAD"):
            continue
        one = adapted(spark, one)
        if made := _MADE.match(one):
            saved(spark.sql(made[2])).createOrReplaceTempView(made[1].strip('`"'))
        else:
            spark.sql(one)
    return adapted(spark, statements[-1])


def _wkb(value) -> bytes | None:
    """Of WKB or of a struct of x and y."""
    if value is None or isinstance(value, (bytes, bytearray)):
        return value
    return None if value["x"] is None or value["y"] is None else to_wkb((POINT, [[[(value["x"], value["y"])]]]))


def _rows(column) -> pd.Series:
    """Geometries of a column of WKB or of structs, which arrive as a frame."""
    if isinstance(column, pd.DataFrame):
        return pd.Series([None if x is None or y is None or x != x or y != y else {"x": x, "y": y} for x, y in zip(column["x"], column["y"])], dtype=object)
    return column


def register_spatial(spark: SparkSession) -> None:
    """``st_point`` is a plain struct, which stays in the JVM; the others are Arrow-batched and take WKB or that struct."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION st_point(lon DOUBLE, lat DOUBLE) RETURNS STRUCT<x: DOUBLE, y: DOUBLE> RETURN named_struct('x', lon, 'y', lat)")

    def register(name: str, kind: str, one):
        @F.pandas_udf(kind)
        def geometry(column: pd.Series) -> pd.Series:
            return _rows(column).map(lambda v: one(g) if (g := from_wkb(_wkb(v))) else None)

        spark.udf.register(name, geometry)

    @F.pandas_udf("binary")
    def st_geomfromtext(text: pd.Series) -> pd.Series:
        return text.map(lambda t: to_wkb(g) if (g := from_wkt(t)) else None)

    @F.pandas_udf("string")
    def st_srid(column: pd.Series) -> pd.Series:
        return _rows(column).map(lambda v: f"EPSG:{n}" if (n := srid_of(_wkb(v))) else None)

    @F.pandas_udf("binary")
    def st_setsrid(column: pd.Series, srid: pd.Series) -> pd.Series:
        return pd.Series([with_srid(_wkb(v), int(n)) for v, n in zip(_rows(column), srid)], dtype=object)

    @F.pandas_udf("binary")
    def st_transform(column: pd.Series, source: pd.Series, target: pd.Series) -> pd.Series:
        out = []
        for v, a, b in zip(_rows(column), source, target):
            g, a, b = from_wkb(_wkb(v)), projections.known(a), projections.known(b)
            out.append(to_wkb(transform(g, lambda x, y, a=a, b=b: projections.transform_point(x, y, a, b))) if g else None)
        return pd.Series(out, dtype=object)

    spark.udf.register("st_geomfromtext", st_geomfromtext)
    spark.udf.register("st_srid", st_srid)
    spark.udf.register("st_setsrid", st_setsrid)
    spark.udf.register("st_transform", st_transform)
    for name, kind, one in (
        ("st_aswkb", "binary", to_wkb),
        ("st_geomfromwkb", "binary", to_wkb),
        ("st_x", "double", lambda g: g[1][0][0][0][0] if g[0] == POINT else None),
        ("st_y", "double", lambda g: g[1][0][0][0][1] if g[0] == POINT else None),
        ("st_geometrytype", "string", lambda g: NAMES[g[0]].upper()),
        ("st_xmin", "double", lambda g: bbox(g)[0]),
        ("st_ymin", "double", lambda g: bbox(g)[1]),
        ("st_xmax", "double", lambda g: bbox(g)[2]),
        ("st_ymax", "double", lambda g: bbox(g)[3]),
    ):
        register(name, kind, one)
