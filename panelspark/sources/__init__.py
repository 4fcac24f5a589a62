"""Scans: all-string CSV, typed JSON lines with corrupt rows kept, gz documents, zipped members, databases, HTML text, keyed upserts."""

from __future__ import annotations

import io
import zipfile
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def read_text_csv(spark: SparkSession, path: str, columns: list[str] | None = None, sep: str = ",", encoding: str = "utf-8") -> DataFrame:
    """CSV or gz with a header, every column text, blank cells null; only the columns asked for."""
    df = spark.read.option("header", True).option("inferSchema", False).option("sep", sep).option("encoding", encoding).option("multiLine", False).csv(path)
    return df.select(*columns) if columns else df


def read_json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, broken): rows that parse under the schema, and the text of those that don't."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__broken"}
    lines = spark.read.text(path).where("trim(value) <> ''")
    parsed = lines.select("value", F.from_json("value", f"{schema}, __broken string", options).alias("r"))
    return parsed.where("r.__broken is null").select("r.*").drop("__broken"), parsed.where("r.__broken is not null").select(F.col("value").alias("line"))


def read_zip_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The first .csv member of every zip, as text columns, with the archive's path."""

    def run(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    member = next((m for m in sorted(archive.namelist()) if m.endswith(".csv")), None)
                    if member:
                        yield pd.read_csv(archive.open(member), dtype=str).assign(archive=name)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, f"{schema}, archive string")


class _Text(HTMLParser):
    def __init__(self):
        super().__init__()
        self.parts: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style") and self.skip > 0

    def handle_data(self, data):
        if not self.skip and data.strip():
            self.parts.append(data.strip())


def html_text(df: DataFrame, html: str, out: str) -> DataFrame:
    """df with the visible text of its pages, pieces joined by line breaks."""

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        def one(page):
            parser = _Text()
            parser.feed(page or "")
            return "\n".join(parser.parts)

        return pages.map(one)

    return df.withColumn(out, run(F.col(html)))


def read_items(spark: SparkSession, path: str, schema: str, day: str = "meeting_date", year: str = "year") -> tuple[DataFrame, DataFrame]:
    """read_json_lines over a sorted set of files, `day` as a date and `year` that of the day, else the record's own."""
    rows, broken = read_json_lines(spark, path, schema)
    typed = rows.withColumn(day, F.try_to_date(F.col(day).cast("string"), "yyyy-MM-dd"))
    return typed.withColumn(year, F.coalesce(F.year(day), F.col(year).try_cast("int"))), broken


def read_wanted(spark: SparkSession, path: str, keys: DataFrame, on: list[str], columns: list[str], sep: str = ",") -> DataFrame:
    """Rows of a large text table whose key is wanted: a pruned scan and a semi join, which streams the large side."""
    rows = read_text_csv(spark, path, sorted({*on, *columns}, key=lambda c: ([*on, *columns].index(c))), sep)
    return rows.join(keys.select(*on).distinct(), on, "left_semi").select(*columns)


def read_documents_gz(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(documents, unreadable): one JSON document a .json.gz file; files that are cut short or no JSON are told, not fatal."""

    def run(batches):
        import gzip

        for pdf in batches:
            texts, errors = [], []
            for content in pdf["content"]:
                try:
                    texts.append(gzip.decompress(content).decode("utf-8"))
                    errors.append(None)
                except (OSError, EOFError, ValueError) as e:
                    texts.append(None)
                    errors.append(type(e).__name__)
            yield pd.DataFrame({"path": pdf["path"], "text": texts, "error": errors})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json.gz").load(path).select("path", "content").mapInPandas(run, "path string, text string, error string")
    parsed = files.withColumn("d", F.from_json("text", f"{schema}, __broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__broken"}))
    good = F.col("text").isNotNull() & F.col("d.__broken").isNull()
    return parsed.where(good).select("path", "d.*").drop("__broken"), parsed.where(~good).select("path", F.coalesce("error", F.lit("not JSON")).alias("error"))


def read_table(spark: SparkSession, url: str, query: str, driver: str) -> DataFrame:
    """A database's query by JDBC, for landing as a table; the driver's jar must be on the class path."""
    return spark.read.format("jdbc").option("url", url).option("driver", driver).option("query", query).load()


def content_kind(content: Column) -> Column:
    """pdf, zip, html or text by the first bytes of a file."""
    head = F.lower(F.decode(F.substring(content, 1, 64), "ISO-8859-1"))
    return F.when(head.startswith("%pdf"), "pdf").when(head.startswith("pk\x03\x04"), "zip").when(head.rlike(r"^\s*<(?:!doctype|html|head|body|\?xml)"), "html").otherwise("text")


def pooled(parts: dict[str, DataFrame], tag: str) -> DataFrame:
    """All parts by column name with the part's name in `tag`; columns that one lacks are null."""
    out = None
    for name, df in parts.items():
        one = df.withColumn(tag, F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def links(html: Column) -> Column:
    """array<string>: the distinct targets of a page's links."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r"<a\s[^>]*href=\"([^\"]*)\""), F.lit(1)))


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of both by key, those of `new` first; columns that one lacks are null. Of several rows of a side the least in all columns stays."""
    both = old.withColumn("__turn", F.lit(1)).unionByName(new.withColumn("__turn", F.lit(0)), allowMissingColumns=True)
    return both.withColumn("__rank", F.row_number().over(W.partitionBy(*key).orderBy("__turn", *sorted(c for c in both.columns if c != "__turn")))).where("__rank = 1").drop("__turn", "__rank")


def write_forms(df: DataFrame, path: str, form: str, chunk: str) -> None:
    """JSON lines in a folder for each form and chunk, which a rerun replaces and the others keep."""
    df.withColumn("form", F.lit(form)).withColumn("chunk", F.lit(chunk)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("form", "chunk").json(path)
