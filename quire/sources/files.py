"""Sources: uploaded files, folders of texts, manifests and archives."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: 50 MiB, the most that an upload may have.
MAX_BYTES = 50 * 1024 * 1024
HEADER = b"%PDF-"


def uploads(spark: SparkSession, folder: str, max_bytes: int = MAX_BYTES, glob: str = "*") -> DataFrame:
    """(id, storage_key, media_type, size_bytes, original_filename, content, error) of the files below `folder`.

    id is the content's SHA-256 and storage_key its place in a content-addressed store. Files over the cap or without
    the header have their `error` and neither id nor content; those over the cap are told by their size and not read.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    error = F.when(F.col("length") > max_bytes, "too_large").when(~F.startswith("content", F.lit(HEADER)), "not_pdf")
    marked = files.select("path", "length", F.when(F.col("length") <= max_bytes, F.col("content")).alias("content"), error.alias("error"))
    name = F.element_at(F.split("path", "/"), -1)
    good = F.col("error").isNull()
    digest = F.when(good, F.sha2("content", 256))
    return marked.select(digest.alias("id"), F.concat(F.lit("pdfs/"), F.substring(digest, 1, 2), F.lit("/"), digest, F.lit(".pdf")).alias("storage_key"), F.lit("application/pdf").alias("media_type"), F.col("length").alias("size_bytes"), name.alias("original_filename"), F.when(good, F.col("content")).alias("content"), "error")


def text_folder(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, title, text, source_path) of the .md and .txt files below `folder`, ids and titles from their names."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{md,txt,MD,TXT}")
    path = F.regexp_replace(F.col("_metadata.file_path"), "^file:(//)?", "")
    stem = F.regexp_replace(F.url_decode(F.element_at(F.split(path, "/"), -1)), r"\.[^.]*$", "")

    @F.pandas_udf(T.StringType())
    def titled(names: pd.Series) -> pd.Series:
        return names.str.replace("_", " ").str.title()

    return files.select(F.replace(F.lower(stem), F.lit(" "), F.lit("-")).alias("doc_id"), titled(stem).alias("title"), F.col("value").alias("text"), path.alias("source_path"))


EVIDENCE = "array<struct<block_id:string,page:int,char_start:int,char_end:int,text:string,block_text:string>>"
MANIFEST = f"documents array<struct<uid:string,source:string,source_page:int,page_count:int,pdf_sha256:string,pdf_file:string>>, queries array<struct<uid:string,document_uid:string,question:string,answer_type:string,scale:string,relevant_pages:array<int>,evidence:{EVIDENCE}>>"


def manifest(spark: SparkSession, path: str, schema: str = MANIFEST) -> DataFrame:
    """A JSON manifest in one piece, with its path and SHA-256 for lineage; malformed JSON raises."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("path", F.col("_metadata.file_path"))
    digests = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
    return rows.join(digests.select(F.regexp_replace("path", "^file:/+", "/").alias("p"), "sha256"), F.regexp_replace("path", "^file:/+", "/") == F.col("p")).drop("p")


def manifest_queries(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("queries").alias("q")).select("q.*")


def archive_members(spark: SparkSession, path: str, suffix: str = ".json") -> DataFrame:
    """(archive, name, content, error) of the members of ZIP files whose name ends in `suffix`; a damaged one has an error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for archive, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as members:
                        for name in members.namelist():
                            if name.endswith(suffix):
                                try:
                                    rows.append((archive, name, members.read(name), None))
                                except (zipfile.BadZipFile, EOFError, OSError) as problem:
                                    rows.append((archive, name, None, str(problem)))
                except zipfile.BadZipFile as problem:
                    rows.append((archive, None, None, str(problem)))
            yield pd.DataFrame(rows, columns=["archive", "name", "content", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, name string, content binary, error string")


class PageExtractor(Protocol):
    """Takes a file's bytes to its pages: dicts of page_number, width, height, method, blocks (text, x0, top, x1, bottom,
    confidence). Parsers and recognisers are plugged in behind this; none is part of this engine."""

    def extract(self, content: bytes) -> list[dict]: ...


class PlainTextExtractor:
    """A stand-in for tests: pages parted by form feeds, a block per line, set in fixed type."""

    def extract(self, content: bytes) -> list[dict]:
        text = content.decode("utf-8", "replace")
        pages = []
        for number, page in enumerate(text.split("\f"), 1):
            lines = [line for line in page.split("\n") if line.strip() and not line.startswith(("%PDF-", "%%EOF"))]
            blocks = [{"text": line, "x0": 36.0, "top": 36.0 + 12 * k, "x1": 36.0 + 5.1 * len(line), "bottom": 45.5 + 12 * k, "confidence": None} for k, line in enumerate(lines)]
            pages.append({"page_number": number, "width": 612.0, "height": 792.0, "method": "direct", "blocks": blocks})
        return pages


EXTRACTED = "document_id string, page_number int, width double, height double, method string, block_order int, text string, x0 double, top double, x1 double, bottom double, confidence double, error string"


def extract_pages(files: DataFrame, extractor: PageExtractor) -> DataFrame:
    """A row per block, or per page or file without one, of files (id, content); a failure is a row with `error`."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [part.split(" ")[0] for part in EXTRACTED.split(", ")]
        for frame in frames:
            rows = []
            for key, content in zip(frame["id"], frame["content"], strict=True):
                try:
                    for page in extractor.extract(bytes(content)):
                        head = (key, page["page_number"], page["width"], page["height"], page["method"])
                        blocks = page["blocks"] or [None]
                        for k, b in enumerate(blocks, 1):
                            rows.append((*head, k, b["text"], b["x0"], b["top"], b["x1"], b["bottom"], b["confidence"], None) if b else (*head, *[None] * 8))
                except Exception as problem:  # noqa: BLE001 - one bad file must not end the job
                    rows.append((key, *[None] * 11, f"{type(problem).__name__}: {problem}"))
            yield pd.DataFrame(rows, columns=names).astype(object).where(lambda d: d.notna(), None)

    return files.select("id", "content").mapInPandas(run, EXTRACTED)


def read_json(text: str) -> dict:
    return json.loads(text)
