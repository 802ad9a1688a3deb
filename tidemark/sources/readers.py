"""Readers: clean station files, database exports, wide daily text, registries, metadata notes, workbooks."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.exprs import parse_number, parse_ts

#: The fields of a database export.
EXPORT = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "code_id", "station_name", "x_utm", "y_utm", "variable", "quality", "timestamp", "value")])
#: Column names of clean files by kind.
CLEAN = {"hydro": ("HEIGHT_m", "WATER_TEMP_C"), "meteo": ("PRECIP_mm", "TEMP_C"), "hourly": ("PRECIP_mm",)}
#: Namespaces of strict workbooks and those that readers expect.
STRICT = {
    "http://purl.oclc.org/ooxml/spreadsheetml/main": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
    "http://purl.oclc.org/ooxml/officeDocument/relationships": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
}


def parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def clean_files(spark: SparkSession, path: str | list[str], kind: str) -> DataFrame:
    """Clean CSV files of one kind as long observations; the series is the file's name and the column."""
    values = CLEAN[kind]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("TIMESTAMP", *values, "QUALITY", "DATA_TYPE")])
    raw = spark.read.schema(schema).option("header", True).csv(path).withColumn("station", F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1))
    each = F.inline(F.array(*[F.struct(F.concat_ws("_", "station", F.lit(v)).alias("series_id"), parse_number(v).alias("value")) for v in values]))
    return raw.select(parse_ts("TIMESTAMP").alias("ts"), F.col("QUALITY").try_cast("int").alias("quality"), F.col("DATA_TYPE").alias("data_type"), each).select("series_id", "ts", "value", "quality", "data_type")


def export_csv(spark: SparkSession, path: str | list[str], variable: str | None = None) -> DataFrame:
    """Rows of a database export; lines with too few fields are dropped, whatever columns are asked for later."""
    df = spark.read.schema(EXPORT).option("header", True).option("mode", "DROPMALFORMED").option("columnPruning", False).csv(path)
    return df.filter(F.col("variable") == variable) if variable else df


def wide_days(spark: SparkSession, path: str | list[str], station: str | None = None) -> DataFrame:
    """``;``-separated latin-1 text of a day per line: station, date, daily total (column 9), hours (columns 10 to 33)."""
    names = [f"c{k}" for k in range(33)]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = spark.read.schema(schema).option("header", True).option("sep", ";").option("encoding", "ISO-8859-1").option("mode", "PERMISSIVE").csv(path)
    df = raw.select(F.trim("c0").alias("station"), *[F.col(f"c{k}").try_cast("int").alias(n) for k, n in ((1, "y"), (2, "m"), (3, "d"))], F.col("c8").alias("p24"), *[F.col(f"c{k + 8}").alias(f"h{k}") for k in range(1, 25)])
    return df.filter(F.col("station") == station) if station else df


def positional(df: DataFrame, columns: dict[str, int]) -> DataFrame:
    """Columns by position under new names."""
    return df.select(*[F.col(f"`{df.columns[k]}`").alias(n) for n, k in columns.items()])


def registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def metadata_notes(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """Fields of free-text notes by pattern (group 1), one row per file."""
    text = spark.read.option("wholetext", True).text(path).select(F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1).alias("station"), "value")
    return text.select("station", *[F.nullif(F.regexp_extract("value", p, 1), F.lit("")).alias(n) for n, p in fields.items()])


def relaxed_workbook(data: bytes) -> bytes:
    """A strict workbook with the usual namespaces and without external references."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as src, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as dst:
        for name in src.namelist():
            body = src.read(name)
            if name.endswith((".xml", ".rels")):
                text = body.decode("utf-8")
                for old, new in STRICT.items():
                    text = text.replace(old, new)
                body = re.sub(r"<externalReferences>.*?</externalReferences>", "", text, flags=re.S).encode("utf-8")
            dst.writestr(name, body)
    return out.getvalue()


def sheet_rows(data: bytes, sheet: str | None = None) -> list[list[str | None]]:
    """Cell texts of a sheet (by name, else the first), row by row with empty cells as None."""
    main, rel = STRICT.values()
    with zipfile.ZipFile(io.BytesIO(relaxed_workbook(data))) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = [(s.get("name"), targets[s.get(f"{{{rel}}}id")]) for s in book.iter(f"{{{main}}}sheet")]
        target = next((t for n, t in sheets if n == sheet), None) if sheet else sheets[0][1]
        if target is None:
            return []
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{main}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{{{main}}}si")]
        rows = []
        for row in ElementTree.fromstring(z.read("xl/" + target.lstrip("/").removeprefix("xl/"))).iter(f"{{{main}}}row"):
            cells: dict[int, str | None] = {}
            for c in row.iter(f"{{{main}}}c"):
                letters = re.match(r"[A-Z]+", c.get("r") or "A")[0]
                at = 0
                for ch in letters:
                    at = at * 26 + ord(ch) - 64
                formula, value = c.find(f"{{{main}}}f"), c.find(f"{{{main}}}v")
                if formula is not None and formula.text:
                    cells[at - 1] = "=" + formula.text
                elif c.get("t") == "inlineStr":
                    cells[at - 1] = "".join(t.text or "" for t in c.iter(f"{{{main}}}t"))
                elif value is not None:
                    cells[at - 1] = shared[int(value.text)] if c.get("t") == "s" else value.text
            rows.append([cells.get(k) for k in range(max(cells, default=-1) + 1)])
    return rows


def workbooks(spark: SparkSession, path: str, width: int, sheet: str | None = None, header: bool = True) -> DataFrame:
    """Sheets of workbooks (one per file) as text columns c0, c1, ...; files are parsed on the executors."""
    schema = "station string, " + ", ".join(f"c{k} string" for k in range(width))

    def parse(frames):
        import pandas as pd

        for frame in frames:
            for name, data in zip(frame["path"], frame["content"]):
                rows = sheet_rows(bytes(data), sheet)[1 if header else 0 :]
                station = name.rsplit("/", 1)[-1].split(".")[0]
                yield pd.DataFrame([[station, *(r + [None] * width)[:width]] for r in rows], columns=["station", *[f"c{k}" for k in range(width)]], dtype=object)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, schema)
