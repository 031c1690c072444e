"""Files in and out: texts of unknown encoding, JSON in several shapes, story packages, event frames."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENCODINGS = ("utf-8", "utf-8-sig", "utf-16", "cp949", "euc-kr")


def decoded(raw: bytes) -> str:
    """The text of some bytes in the first encoding that fits; bytes that fit none are left out."""
    if raw.startswith(b"\xef\xbb\xbf"):
        return raw[3:].decode("utf-8", "ignore")
    for name in ENCODINGS:
        try:
            return raw.decode(name)
        except UnicodeError:
            continue
    return raw.decode("utf-8", "ignore")


def decoded_texts(df: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(key, text) of bytes in whatever encoding; null bytes give null."""
    kind = df.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"key": p["key"], "text": [None if b is None else decoded(bytes(b)) for b in p["content"]]})

    return df.select(F.col(key).alias("key"), F.col(content).alias("content")).mapInPandas(run, f"key {kind}, text string").withColumnRenamed("key", key)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files, whatever their encoding."""
    return decoded_texts(spark.read.format("binaryFile").load(path), "path")


def read_json_lines(spark: SparkSession, path: str, schema: str, limit: int | None = None) -> DataFrame:
    """One object a line; lines that don't parse are left out."""
    rows = spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path).where("_bad is null").drop("_bad")
    return rows if limit is None else rows.limit(limit)


def records(text: Column) -> Column:
    """The records of a JSON text as JSON strings: a list, a list under a known key, lines, or one object."""
    lists = [F.get_json_object(text, f"$.{k}") for k in ("records", "items", "nodes", "edges", "data")]
    inner = F.coalesce(*lists)
    as_list = lambda x: F.from_json(x, "array<string>")
    lines = F.filter(F.transform(F.split(text, "\n"), F.trim), lambda x: F.get_json_object(x, "$").isNotNull() & (x != ""))
    return F.when(F.trim(text).startswith("["), as_list(text)).when(inner.isNotNull(), as_list(inner)).when(F.get_json_object(text, "$").isNotNull() & ~F.trim(text).contains("\n"), F.array(text)).otherwise(lines)


def has_role(path: Column, role: str) -> Column:
    """Whether a file's name, with or without its ending, is a role's; case and slashes don't matter."""
    name = F.regexp_extract(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), r"([^/]+)$", 1)
    return (name == role.lower()) | (F.regexp_replace(name, r"\.[^.]*$", "") == role.lower())


def packed(story: Column, obfuscated: bool = False) -> Column:
    """A story's JSON text as a package: as it is, or in URL-safe base64 without padding."""
    coded = F.regexp_replace(F.translate(F.base64(story.cast("binary")), "+/", "-_"), r"[=\r\n]", "")
    return F.concat(F.lit("obfuscated-v1:"), coded) if obfuscated else F.concat(F.lit("json-v1:"), story)


def unpacked(package: Column) -> Column:
    body = F.regexp_replace(package, "^[a-z]+-v1:", "")
    padded = F.concat(F.translate(body, "-_", "+/"), F.repeat(F.lit("="), F.pmod(-F.length(body), F.lit(4))))
    return F.when(package.startswith("obfuscated-v1:"), F.try_to_binary(padded, F.lit("base64")).cast("string")).when(package.startswith("json-v1:"), body)


def event_frames(text: Column) -> Column:
    """(seq, data) of each frame of an event-stream text; frames without data are left out."""
    frames = F.transform(F.split(F.regexp_replace(text, "\r\n", "\n"), "\n\n"), lambda f: F.struct(
        F.regexp_extract(f, r"(?m)^id:\s*(\d+)", 1).try_cast("long").alias("seq"),
        F.array_join(F.regexp_extract_all(f, F.lit(r"(?m)^data:\s?(.*)$"), F.lit(1)), "\n").alias("data"),
    ))
    return F.filter(frames, lambda x: x["data"] != "")


def write_text(df: DataFrame, path: str, text: str = "text") -> None:
    """One line of output for each row, newlines kept as they are."""
    df.select(F.col(text).alias("value")).write.mode("overwrite").text(path)


def write_texts(df: DataFrame, path: str, key: str, text: str = "text") -> None:
    """A folder key=... for each key, with its text and a newline behind it in a file; null texts have none."""
    df.where(F.col(text).isNotNull()).select(key, F.col(text).alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Overwrites only those partitions of a table that df has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


#: The parts of a word-processor package besides its text, and the text's frame.
DOCX_PARTS = {
    "[Content_Types].xml": '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
    "_rels/.rels": '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
}
WORD_SPACE = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
NOT_IN_XML = re.compile("[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")


def docx_of(text: str) -> bytes:
    """A text as a word-processor package, a paragraph for each line; characters that XML has no place for are left out."""
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(NOT_IN_XML.sub("", line), {chr(13): "&#13;"})}</w:t></w:r></w:p>' for line in text.split("\n"))
    parts = DOCX_PARTS | {"word/document.xml": f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:document xmlns:w="{WORD_SPACE}"><w:body>{body}</w:body></w:document>'}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, part in parts.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), part)
    return out.getvalue()


def text_of_docx(package: bytes) -> str:
    """The paragraphs of a word-processor package, joined by newlines."""
    with zipfile.ZipFile(io.BytesIO(package)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return "\n".join("".join(t.text or "" for t in p.iter(f"{{{WORD_SPACE}}}t")) for p in root.iter(f"{{{WORD_SPACE}}}p"))


def as_docx(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, docx) of each row; null counts as an empty text. The files are the binary column: no task writes beside Spark."""
    kind = df.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"key": p["key"], "docx": [docx_of(t or "") for t in p["text"]]})

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {kind}, docx binary").withColumnRenamed("key", key)


def from_docx(df: DataFrame, key: str, docx: str = "docx") -> DataFrame:
    """(key, text) of each row's package."""
    kind = df.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"key": p["key"], "text": [text_of_docx(bytes(b)) for b in p["docx"]]})

    return df.select(F.col(key).alias("key"), F.col(docx).alias("docx")).mapInPandas(run, f"key {kind}, text string").withColumnRenamed("key", key)
