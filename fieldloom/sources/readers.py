"""Sources: delimited text, spreadsheets, GeoJSON, GeoPackage, Parquet, with one reading of missing values.

Files are read through Spark's readers, so that any store Spark knows will do. Formats without a reader there
(spreadsheets, GeoPackage) come as binary files and are opened where they arrive, one file a task.
"""

from __future__ import annotations

import csv
import io
import itertools
import re
import sqlite3
import struct
import tempfile
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..contracts import require

# Extensions and their drivers.
FORMATS = {
    "parquet": "parquet", "csv": "csv", "tsv": "csv", "tab": "csv", "json": "json", "geojson": "geojson", "geojsonl": "json", "orc": "orc", "txt": "text",
    "xlsx": "xlsx", "gpkg": "gpkg",
}


def read_text_table(spark: SparkSession, path: str, encoding: str = "UTF-8", separator: str = ",", header_row: int = 1, promote: bool = False, keep_text: tuple[str, ...] = ()) -> DataFrame:
    """A delimited file, all columns text, empty cells null; repeated names are refused, rows without any value dropped.

    header_row > 1 skips title rows. promote: a column whose every value is a number becomes double, but for keep_text.
    """
    require(header_row >= 1, "header row numbers start at 1")
    if encoding.upper() not in ("UTF-8", "US-ASCII", "ISO-8859-1", "UTF-16", "UTF-16BE", "UTF-16LE", "UTF-32"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")  # other encodings than the standard ones
    opts = {"encoding": encoding, "sep": separator, "header": "false", "inferSchema": "false", "multiLine": "true", "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    start = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 1 << 20)).first()
    require(start is not None, f"no file at {path}")
    lines = list(itertools.islice(csv.reader(io.StringIO(bytes(start[0]).decode(encoding, "replace").lstrip("\ufeff"), newline=""), delimiter=separator), header_row))
    require(len(lines) == header_row, "no header row")
    names = [v.strip() for v in lines[-1]]
    # a file is read by one task, as rows may span lines; its first rows are titles and the header
    df = spark.read.options(**opts).schema(", ".join(f"`c{k}` string" for k in range(len(names)))).csv(path)
    file = Window.partitionBy("_file").orderBy("_n")
    df = df.withColumns({"_file": F.input_file_name(), "_n": F.monotonically_increasing_id()}).withColumn("_row", F.row_number().over(file)).where(F.col("_row") > header_row).drop("_file", "_n", "_row")
    require(len(set(names)) == len(names), "repeated column names; choose the header row")
    df = df.toDF(*names)
    df = df.where(F.coalesce(*(F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in names)).isNotNull())
    return promote_numbers(df, keep_text) if promote else df


def promote_numbers(df: DataFrame, keep_text: tuple[str, ...] = ()) -> DataFrame:
    """Text columns whose every present value parses become double; found in one pass."""
    names = [c for c in df.columns if c not in keep_text]
    number = lambda c: F.expr(f"try_cast(trim(`{c}`) as double)")
    counts = df.agg(*(F.struct(F.count(f"`{c}`"), F.count(number(c))).alias(c) for c in names)).first()
    return df.withColumns({c: number(c) for c in names if counts[c][0] and counts[c][0] == counts[c][1]})


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features of a collection: properties as columns, geometry as JSON text with type, x and y for points."""
    raw = spark.read.option("multiLine", "true").json(path)
    f = raw.select(F.explode("features").alias("f"))
    kind = f.schema["f"].dataType
    properties = kind["properties"].dataType.fieldNames() if "properties" in kind.fieldNames() else []
    g = F.col("f.geometry")
    point = F.when(g["type"] == "Point", F.from_json(F.to_json(g), "coordinates array<double>")["coordinates"])
    return f.select(*(F.col(f"f.properties.`{p}`").alias(p) for p in properties), g["type"].alias("geometry_type"), F.to_json(g).alias("geometry"), point[0].alias("x"), point[1].alias("y"))


def _sheet_rows(content: bytes, sheet: int) -> list[list[str | None]]:
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{ns}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        sheets = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        rows = []
        for row in ElementTree.fromstring(z.read(sheets[sheet])).iter(f"{ns}row"):
            cells: dict[int, str | None] = {}
            for c in row.iter(f"{ns}c"):
                at = 0
                for ch in re.match(r"[A-Z]+", c.get("r"))[0]:
                    at = at * 26 + ord(ch) - 64
                v = c.find(f"{ns}v")
                text = "".join(t.text or "" for t in c.iter(f"{ns}t")) if c.get("t") == "inlineStr" else (v.text if v is not None else None)
                cells[at - 1] = shared[int(text)] if c.get("t") == "s" and text is not None else text
            rows.append([cells.get(k) for k in range(max(cells, default=-1) + 1)])
    return rows


def read_xlsx(spark: SparkSession, path: str, sheet: int = 0, header_row: int = 1) -> DataFrame:
    """A sheet, all columns text."""
    @F.udf("array<array<string>>")
    def rows(content):
        return _sheet_rows(bytes(content), sheet)

    lines = spark.read.format("binaryFile").load(path).select(F.posexplode(rows("content")).alias("n", "cells"))
    head = lines.where(F.col("n") == header_row - 1).first()
    require(head is not None, "no header row")
    names = [str(v or "").strip() for v in head["cells"]]
    require(len(set(names)) == len(names), "repeated column names; choose the header row")
    data = lines.where(F.col("n") >= header_row).select(*(F.get("cells", F.lit(k)).alias(c) for k, c in enumerate(names)))
    return data.where(F.coalesce(*(F.col(f"`{c}`") for c in names)).isNotNull())


def _gpkg(content: bytes, query: str) -> list[tuple]:
    with tempfile.NamedTemporaryFile(suffix=".gpkg") as f:
        f.write(content)
        f.flush()
        con = sqlite3.connect(f"file:{f.name}?mode=ro&immutable=1", uri=True)
        try:
            return con.execute(query).fetchall()
        finally:
            con.close()


def gpkg_layers(spark: SparkSession, path: str) -> DataFrame:
    """layer, data_type, srs_id of the tables that a GeoPackage lists."""
    @F.udf("array<struct<layer:string,data_type:string,srs_id:int>>")
    def layers(content):
        return _gpkg(bytes(content), "SELECT table_name, data_type, srs_id FROM gpkg_contents ORDER BY 1")

    return spark.read.format("binaryFile").load(path).select(F.inline(layers("content")))


def _wkb(blob: bytes | None) -> bytes | None:
    """The well-known binary behind a GeoPackage header."""
    if blob is None or blob[:2] != b"GP":
        return blob
    envelope = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[(blob[3] >> 1) & 7]
    return blob[8 + envelope :]


def read_gpkg(spark: SparkSession, path: str, layer: str, geometry: str = "geom") -> DataFrame:
    """A layer: attributes as text, geometry as well-known binary, x and y of points."""
    require(re.fullmatch(r"[^\"\x00]+", layer) is not None, "bad layer name")

    @F.udf("array<string>")
    def names(content):
        return [r[1] for r in _gpkg(bytes(content), f'PRAGMA table_info("{layer}")')]

    files = spark.read.format("binaryFile").load(path)
    columns = files.select(names("content")).first()[0]
    require(bool(columns), f"no layer {layer}")
    attributes = [c for c in columns if c != geometry]

    @F.udf("array<struct<a:array<string>,g:binary,x:double,y:double>>")
    def rows(content):
        listed = ", ".join(f'"{c}"' for c in [*attributes, geometry] if c in columns)
        out = []
        for r in _gpkg(bytes(content), f'SELECT {listed} FROM "{layer}"'):
            g = _wkb(r[-1]) if geometry in columns else None
            x = y = None
            if g and struct.unpack_from("<I" if g[0] else ">I", g, 1)[0] == 1:
                x, y = struct.unpack_from("<dd" if g[0] else ">dd", g, 5)
            out.append(([None if v is None else str(v) for v in r[: len(attributes)]], g, x, y))
        return out

    r = files.select(F.inline(rows("content")).alias("a", "geometry", "x", "y"))
    return r.select(*(F.get("a", F.lit(k)).alias(c) for k, c in enumerate(attributes)), "geometry", "x", "y")


def read_any(spark: SparkSession, path: str, layer: str | None = None, **options) -> DataFrame:
    """By extension."""
    kind = FORMATS.get(path.rstrip("/").rsplit(".", 1)[-1].lower())
    require(kind is not None, f"no reader for {path}")
    if kind == "csv":
        return read_text_table(spark, path, **({"separator": "\t"} if not path.endswith("csv") else {}), **options)
    if kind == "geojson":
        return read_geojson(spark, path)
    if kind == "xlsx":
        return read_xlsx(spark, path, **options)
    if kind == "gpkg":
        require(layer is not None, "name the layer; the first one isn't taken silently")
        return read_gpkg(spark, path, layer, **options)
    return spark.read.format(kind).options(**options).load(path)


def read_window(spark: SparkSession, path: str, box: tuple[float, float, float, float], columns: list[str] | None = None, where: str | None = None) -> DataFrame:
    """Rows of a Parquet feature table that meet a box; bounds and expression reach the scan, only asked columns are read."""
    x0, y0, x1, y1 = box
    df = spark.read.parquet(path).where((F.col("xmin") <= x1) & (F.col("xmax") >= x0) & (F.col("ymin") <= y1) & (F.col("ymax") >= y0))
    if where:
        from ..functions.filters import where as compiled

        df = df.where(compiled(where))
    return df.select(*columns) if columns else df


def describe(spark: SparkSession, path: str) -> dict:
    """Fields and formats from headers alone."""
    df = read_any(spark, path) if not path.endswith(".gpkg") else gpkg_layers(spark, path)
    return {"path": path, "driver": FORMATS.get(path.rsplit(".", 1)[-1].lower()), "fields": [{"name": f.name, "type": f.dataType.simpleString(), "nullable": f.nullable} for f in df.schema.fields]}


# Files beside a dataset that hold a part of it.
OPEN_DATABASE, RASTER_SIDECARS = ("-wal", "-shm", "-journal"), (".msk", ".aux.xml", ".ovr")


def fingerprint(spark: SparkSession, path: str, raster: bool = False) -> str:
    """SHA-256 of a single-file dataset. Refused: folders, shapefiles (several files), databases in use and, for rasters,
    files with parts beside them, as the hash would not hold these."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store = where(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    require(store.exists(where(path)) and store.getFileStatus(where(path)).isFile(), "a single-file dataset is needed")
    require(not path.lower().endswith(".shp"), "a shapefile is several files: convert it first")
    beside = [x for x in OPEN_DATABASE + (RASTER_SIDECARS if raster else ()) if store.exists(where(path + x))]
    require(not beside, f"files beside the dataset hold a part of it: {', '.join(beside)}")
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]
