"""Markdown note folders and JSON lines, as tables and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import trimmed
from lectern.operators.texts import BLOCK, field_of

#: Files beyond this are reported, not read.
MOST_BYTES = 10 << 20
CATALOG = ["title", "category", "summary", "created", "updated", "lifecycle"]


def note_files(spark: SparkSession, root: str) -> DataFrame:
    """`path, name, size, mtime, content` of Markdown files below a folder; hidden files and folders are left out.

    The content column is only read where a query asks for it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(_roots(spark, root))
    path = F.regexp_replace(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), ".*?" + _quoted(root.rstrip("/")) + "/", "")
    rows = files.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")
    return rows.filter(~F.regexp_like("path", F.lit(r"(^|/)\."))).select("path", _name(F.col("path")).alias("name"), "size", "mtime", "content")


def _roots(spark: SparkSession, root: str) -> list[str]:
    """The folder, and each folder or note below it whose name begins with `_`, which Spark only reads where it is named."""
    hadoop, found, above = spark._jvm.org.apache.hadoop.fs, [root], root.rstrip("/")
    files = hadoop.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    while any(status.isDirectory() for status in files.globStatus(hadoop.Path(f"{above}/*")) or []):
        found += [status.getPath().toString() for status in files.globStatus(hadoop.Path(f"{above}/_*")) if status.isDirectory() or status.getPath().getName().endswith(".md")]
        above += "/*"
    return found


def _quoted(text: str) -> str:
    return r"\Q" + text + r"\E"


def _name(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.md$", "")


def read_notes(spark: SparkSession, root: str, most: int = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """`path, name, size, mtime, raw` of the notes of a folder, and `path, size` of those too large."""
    files = note_files(spark, root)
    notes = files.filter(F.col("size") <= most).select("path", "name", "size", "mtime", F.decode("content", "UTF-8").alias("raw"))
    return notes, files.filter(F.col("size") > most).select("path", "size")


def signatures(files: DataFrame, prefix: int | None = None) -> DataFrame:
    """`path, digest` of files: of size, time and content, or only its first `prefix` bytes."""
    head = F.col("content") if prefix is None else F.substr("content", F.lit(1), F.lit(prefix))
    return files.select("path", F.sha2(F.concat_ws("|", F.col("size").cast("string"), F.col("mtime").cast("string"), F.sha2(head, 256)), 256).alias("digest"))


def _list(text: Column) -> Column:
    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\[|\]$", ""), ",")
    return F.filter(F.transform(parts, lambda t: trimmed(F.regexp_replace(trimmed(t), "^[\"']|[\"']$", ""))), lambda t: t != "")


def catalog_of(notes: DataFrame) -> DataFrame:
    """The catalog's fields of notes `path, name, raw`, from one-line fields of the front matter; title falls back to the name."""
    raw = F.col("raw")
    fields = [field_of(raw, f).alias(f) for f in CATALOG]
    found = notes.select("path", F.col("name").alias("basename"), *fields, _list(field_of(raw, "tags")).alias("tags"), _list(field_of(raw, "aliases")).alias("aliases"), F.regexp_like(raw, F.lit(BLOCK)).alias("has_fields"))
    return found.withColumn("title", F.coalesce("title", "basename"))


def write_days(rows: DataFrame, at: str, folder: str) -> None:
    """Appends rows as JSON lines, one folder a day of the column `at`."""
    rows.withColumn("day", F.to_date(at)).write.mode("append").partitionBy("day").json(folder)


def read_days(spark: SparkSession, folder: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON lines of a schema, and `line` of those that can't be read."""
    parsed = F.from_json("value", f"{schema}, unread string", {"columnNameOfCorruptRecord": "unread"})
    rows = spark.read.text(folder).filter(F.trim("value") != "").select("value", parsed.alias("row"))
    return rows.filter("row.unread is null").select("row.*").drop("unread"), rows.filter("row.unread is not null").select(F.col("value").alias("line"))


def write_version(rows: DataFrame, folder: str, version: int) -> str:
    """Writes a new version beside the older ones; an existing one is never overwritten."""
    rows.write.mode("errorifexists").parquet(target := f"{folder}/version={version:08d}")
    return target
