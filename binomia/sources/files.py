"""File sources: text, JSON artefacts, office documents."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binomia.operators import dictionary as D
from binomia.operators.dictionary import Dictionary
from binomia.sources.ledger import Ledger

NAME = "struct<class:string,order:string,family:string,author:string,occurrence:string,flags:string,common_name_en:string,common_name_es:string,common_name_fr:string>"
META = "struct<edition:int,year:int,source:string,species_count:int,synonym_count:int,synonym_source:string>"
DICTIONARY = f"metadata {META}, valid_names map<string,{NAME}>, genera array<string>, synonyms map<string,string>"
CACHE = "valid boolean, current_name string, synonyms array<string>"
RESULT = "candidates_found long, unique_binomials long, classifications map<string,long>, details array<struct<binomial:string,type:string,suggestion:string,commonName:string>>, source_file string"


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, page, line_no, line) of text files, a form feed ending a page; blank lines are left out."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\\f")).alias("page", "body"))
    return whole.select("file", "page", F.posexplode(F.split("body", "\\r?\\n")).alias("line_no", "line")).where(F.trim("line") != "")


def text_dir(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of the .txt files in a folder."""
    return spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


def json_dir(spark: SparkSession, path: str, schema: str = RESULT, lines: bool = False) -> DataFrame:
    """JSON files in a folder, a row each, with their stem. lines: a row a line, as Spark writes them."""
    own = T.StructType.fromDDL(schema)
    rows = spark.read.schema(own).option("multiLine", not lines).option("pathGlobFilter", "*.json").json(path)
    return rows.select(F.regexp_replace(F.col("_metadata.file_name"), "\\.json$", "").alias("stem"), *own.names)


def or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or an empty one where there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def dictionary_json(spark: SparkSession, path: str) -> tuple[Dictionary, DataFrame]:
    """The dictionary artefact and its metadata; keys keep their order."""
    raw = spark.read.schema(DICTIONARY).option("multiLine", True).json(path)
    valid = raw.select(F.posexplode(F.map_entries("valid_names")).alias("ord", "e")).select(F.col("ord").cast("long"), F.col("e.key").alias("binomial"), F.coalesce("e.value.flags", F.lit("")).alias("flags"), F.coalesce("e.value.common_name_en", F.lit("")).alias("common_name"))
    synonyms = raw.select(F.posexplode(F.map_entries("synonyms")).alias("ord", "e")).select(F.col("ord").cast("long"), F.col("e.key").alias("old_name"), F.col("e.value").alias("new_name")).where(F.contains("old_name", F.lit(" ")))
    common = valid.where("common_name <> ''").select("ord", F.col("common_name").alias("name"), "binomial")
    genera = raw.select(F.explode("genera").alias("genus")).select(F.lower("genus").alias("l_genus")).distinct()
    return Dictionary(D.valid_names(valid), D.synonym_names(synonyms), genera, D.common_names(common)), raw.select("metadata.*")


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def docx_text(body: bytes) -> str:
    """Paragraphs of a word document, a line each."""
    with zipfile.ZipFile(io.BytesIO(body)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return "\n".join("".join(t.text or "" for t in p.iter(f"{_W}t")) for p in root.iter(f"{_W}p"))


def xlsx_text(body: bytes) -> str:
    """All sheets of a workbook as CSV, joined by a line break."""
    with zipfile.ZipFile(io.BytesIO(body)) as z:
        names = z.namelist()
        shared = [] if "xl/sharedStrings.xml" not in names else ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
        sheets = []
        for name in sorted((n for n in names if n.startswith("xl/worksheets/sheet")), key=lambda n: (len(n), n)):
            rows = []
            for row in ElementTree.fromstring(z.read(name)).iter(f"{_S}row"):
                cells = []
                for c in row.iter(f"{_S}c"):
                    v = c.find(f"{_S}v")
                    text = "".join(t.text or "" for t in c.iter(f"{_S}t")) if v is None else v.text or ""
                    text = shared[int(text)] if c.get("t") == "s" else text
                    cells.append('"' + text.replace('"', '""') + '"' if any(x in text for x in ',"\n') else text)
                rows.append(",".join(cells))
            sheets.append("\n".join(rows))
    return "\n".join(sheets)


def pdf_text(body: bytes) -> str:
    """Pages of a PDF, those with text joined by a blank line; needs a PDF reader, which is optional."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise ValueError("PDF files need the pypdf library") from e
    pages = [p.extract_text() or "" for p in PdfReader(io.BytesIO(body)).pages]
    return "\n\n".join(p for p in pages if p.strip())


READERS = {"txt": lambda b: b.decode(errors="replace"), "csv": lambda b: b.decode(errors="replace"), "docx": docx_text, "xlsx": xlsx_text, "pdf": pdf_text}


def to_text(name: str, body: bytes) -> str:
    kind = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if kind not in READERS:
        raise ValueError(f"unsupported file type: {name}")
    return READERS[kind](body)


def import_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, text, error) of files of any supported type; one of another type, or a damaged one, has an error and no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, error = [], []
            for name, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    text.append(to_text(name, body))
                    error.append(None)
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    text.append(None)
                    error.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string()), pa.array(error, pa.string())], names=["file", "text", "error"])

    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return files.mapInArrow(run, "file string, text string, error string")


def joined_pages(pages: DataFrame, key: str, page: str = "page", text: str = "text", separator: str = "\n\n") -> DataFrame:
    """(key, text): pages with text in order, joined."""
    own = pages.where(F.trim(text) != "").groupBy(key).agg(F.sort_array(F.collect_list(F.struct(page, text))).alias("p"))
    return own.select(key, F.array_join(F.col(f"p.{text}"), separator).alias("text"))


def joined_items(items: DataFrame, key: str, page: str = "page", item: str = "item", text: str = "text") -> DataFrame:
    """(key, text): a page's items in order, joined by a space, and the pages by a line break; pages without text stay as empty lines."""
    pages = items.groupBy(key, page).agg(F.sort_array(F.collect_list(F.struct(item, F.coalesce(text, F.lit("")).alias("text")))).alias("p"))
    lines = pages.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(page, F.array_join("p.text", " ").alias("text")))).alias("p"))
    return lines.select(key, F.array_join("p.text", "\n").alias("text"))


def read_cache(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """A cache that rows are appended to by commits: of each key the row of the latest writing; empty where there is none yet."""
    rows = Ledger(spark, path).read("rows", f"{schema}, written_at long")
    rest = [c for c in rows.columns if c not in (key, "written_at")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "written_at").alias("m")).select(key, "m.*")
