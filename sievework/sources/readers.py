"""Sources: parameterised SQL, documents as files, JSON-lines ledgers, manifests, embedding caches, schemas."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from sievework.functions.text import suffix_of

LEDGER_SCHEMA = "at double, model string, sections long, chars long, provider string, purpose string, tokens long"
MAX_EXPANSION = 80 << 20

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Parts of a document that make its text incomplete.
_UNREADABLE = (b"<w:txbxContent", b"<w:altChunk", b"<w:object", b"<w:drawing", b"<w:pict", b"<w:del ", b"<w:ins ")


def rows(spark: SparkSession, sql: str, args: dict | None = None, **frames: DataFrame) -> DataFrame:
    """SQL with named parameters, :name, over frames by {name}."""
    return spark.sql(sql, args=args or {}, **frames)


def one(spark: SparkSession, sql: str, args: dict | None = None, **frames: DataFrame) -> Row | None:
    return rows(spark, sql, args, **frames).first()


def listing(spark: SparkSession, path: str, pattern: str = "*", max_bytes: int | None = None) -> DataFrame:
    """Files of a folder with size and time; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "length")
    return found.where(F.col("length") <= max_bytes) if max_bytes else found


def unchanged(spark: SparkSession, path: str, between: Callable[[], None], pattern: str = "*", max_bytes: int | None = None) -> DataFrame:
    """Files of a folder whose size and time are the same before and after `between()`, which reads them. Those above
    the limit, changed, removed or new ones are left out. The listing before is a table in the shared folder; a scan of
    sources.folders checks each file around its own read."""
    from sievework.plans.session import workspace

    before = workspace(spark, "listing") + "/before"
    listing(spark, path, pattern, max_bytes).write.parquet(before)
    between()
    held = spark.read.schema("path string, modificationTime timestamp, length long").parquet(before)
    return held.join(listing(spark, path, pattern, max_bytes), ["path", "modificationTime", "length"], "left_semi")


def settings(spark: SparkSession, path: str) -> DataFrame:
    """Key, value (JSON) of the settings at `path`: what was put last by `at` holds."""
    rows = spark.read.schema("key string, value string, at long").json(path)
    return rows.groupBy("key").agg(F.max_by("value", "at").alias("value"))


def setting(spark: SparkSession, path: str, key: str, default: str | None = None) -> str | None:
    """One setting, as JSON, or the default."""
    found = settings(spark, path).where(F.col("key") == key).first()
    return found["value"] if found else default


def text_documents(spark: SparkSession, path: str) -> DataFrame:
    """S3: path, text, error of text files: UTF-8 with or without a mark; a NUL means that it is no text."""
    body = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(suffix_of("path") == ".txt")
    marked = F.hex(F.substring("content", 1, 3)) == "EFBBBF"
    plain = F.try_to_binary(F.hex(F.when(marked, F.expr("substring(content, 4)")).otherwise(F.col("content"))), F.lit("hex"))
    text = F.try_validate_utf8(plain.cast("string"))
    error = F.when(text.isNull(), "not UTF-8").when(F.contains(text, F.lit("\0")), "Text contains binary content")
    return body.select("path", F.when(error.isNull(), text).alias("text"), error.alias("error"))


def docx_text(body: bytes) -> tuple[str | None, str | None]:
    """(text, error) of a DOCX: paragraphs of the body, then of headers and footers, tables and nested ones included.

    What cannot be read in full is an error rather than a part: text boxes, pictures, tracked changes, notes.
    """
    try:
        with zipfile.ZipFile(io.BytesIO(body)) as archive:
            if sum(f.file_size for f in archive.infolist()) > MAX_EXPANSION:
                return None, "DOCX expansion exceeds limit"
            parts = {n: archive.read(n) for n in archive.namelist() if n.startswith("word/") and n.endswith(".xml")}
    except (zipfile.BadZipFile, OSError, EOFError, NotImplementedError, RuntimeError):
        return None, "not a DOCX"
    if "word/document.xml" not in parts:
        return None, "not a DOCX"
    if any(tag in xml for xml in parts.values() for tag in _UNREADABLE):
        return None, "DOCX has content that cannot be read in full"
    if any(b"<w:t" in parts.get(f"word/{n}.xml", b"") for n in ("footnotes", "endnotes")):
        return None, "DOCX has notes"
    lines = []
    for name in ["word/document.xml", *sorted(n for n in parts if re.fullmatch(r"word/(?:header|footer)\d*\.xml", n))]:
        try:
            root = ElementTree.fromstring(parts[name])
        except ElementTree.ParseError:
            return None, "not a DOCX"
        lines += ["".join(t.text or "" for t in p.iter(f"{_W}t")) for p in root.iter(f"{_W}p")]
    return "\n".join(lines), None


def docx_documents(spark: SparkSession, path: str) -> DataFrame:
    """Path, text, error of DOCX files. Parsing is an Arrow UDF over file contents."""

    def parse(contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([docx_text(bytes(c)) for c in contents], columns=["text", "error"], dtype=object)

    body = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(suffix_of("path") == ".docx")
    return body.select("path", F.pandas_udf(parse, "text string, error string")("content").alias("r")).select("path", "r.*")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Text and DOCX files of a folder. Other files are listed with an error: their formats need libraries that are not here."""
    other = listing(spark, path).where(~suffix_of("path").isin(".txt", ".docx")).select("path", F.lit(None).cast("string").alias("text"), F.lit("unsupported format").alias("error"))
    return text_documents(spark, path).unionByName(docx_documents(spark, path)).unionByName(other)


def parsed_lines(lines: DataFrame, schema: str = LEDGER_SCHEMA, column: str = "value") -> DataFrame:
    """JSON objects of a column of lines; torn, corrupt and other lines are left out."""
    value = F.trim(F.col(column))
    whole = F.try_parse_json(value)
    is_object = F.coalesce(F.schema_of_variant(whole).startswith("OBJECT"), F.lit(False))
    return lines.where(is_object).select(F.from_json(value, schema).alias("e")).select("e.*")


def ledger(spark: SparkSession, path: str, schema: str = LEDGER_SCHEMA) -> DataFrame:
    """A ledger of JSON lines; a folder that is not there is an empty one."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return parsed_lines(spark.read.text(path), schema)


def manifest(spark: SparkSession, path: str, schema: str, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Entries of a JSON manifest by a composite key."""
    return wanted.join(spark.read.schema(schema).option("multiLine", "true").json(path), keys)


def cache_key(identity: str, purpose: str, text: Column) -> Column:
    """What an embedding is kept under."""
    return F.sha2(F.concat(F.lit(f"{identity}\0{purpose}\0"), text), 256)


def embedded(df: DataFrame, cached: DataFrame, embed: Callable[[list[str]], list[list[float]]], identity: str, purpose: str = "document", text: str = "text", batch: int = 64) -> tuple[DataFrame, DataFrame]:
    """(rows with their vectors, vectors to add to the cache). Only texts that the cache lacks are embedded, each once, in batches."""
    keyed = df.withColumn("_key", cache_key(identity, purpose, F.col(text)))
    missing = keyed.select("_key", F.col(text).alias("_text")).dropDuplicates(["_key"]).join(cached.select(F.col("key").alias("_key")), "_key", "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lo in range(0, len(frame), batch):
                part = frame.iloc[lo : lo + batch]
                yield pd.DataFrame({"key": part["_key"], "embedding": embed(list(part["_text"]))})

    fresh = missing.mapInPandas(run, "key string, embedding array<double>")
    known = cached.select("key", "embedding").unionByName(fresh)
    return keyed.join(known, keyed["_key"] == known["key"], "left").drop("_key", "key"), fresh


def schema_plan(df: DataFrame, keys: list[str] = ()) -> list[tuple[str, str, bool]]:
    """(column, type in a mirror, part of the key)."""
    return [(f.name, mirror_type(f.dataType), f.name in keys) for f in df.schema]


def mirror_type(kind: DataType) -> str:
    """Whole numbers, fractions, and text for all else."""
    name = kind.typeName()
    return "bigint" if name in ("byte", "short", "integer", "long", "boolean") else "double precision" if name in ("float", "double", "decimal") or name.startswith("decimal") else "text"


def of_schema(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A written snapshot: what was read once stays as it was."""
    return spark.read.schema(schema).parquet(path)
