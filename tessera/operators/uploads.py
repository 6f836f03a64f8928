"""Uploaded documents: format by name, declared type and first bytes, pages of PDFs, entries of ZIP archives."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Types that may be declared, limits of archives, and codes of what is rejected.
PDF, DOCX = "application/pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
MOST_ENTRIES, MOST_EXPANSION, MOST_EXPANDED = 1_000, 100, 100_000_000
PAGE, ENCRYPTED = re.compile(rb"/Type\s*/Page(?![A-Za-z])"), re.compile(rb"/Encrypt\b")


def pdf_result(content: bytes, most_pages: int) -> tuple[int | None, str | None]:
    """(pages, None) or (None, code): pages are counted in the file's plain objects, those in compressed streams are not seen."""
    if b"startxref" not in content or b"%%EOF" not in content[-2048:]:
        return None, "malformed_pdf"
    if ENCRYPTED.search(content):
        return None, "password_protected_document"
    pages = len(PAGE.findall(content))
    if not pages:
        return None, "image_only_or_malformed_pdf"
    return (None, "page_limit_exceeded") if pages > most_pages else (pages, None)


def docx_result(content: bytes) -> str | None:
    """What is wrong with a DOCX by its central directory; null if nothing. Only what passes has its document unpacked, to its stated size."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
        entries = archive.infolist()
    except (zipfile.BadZipFile, NotImplementedError, ValueError, OSError):
        return "malformed_docx"
    names = {e.filename.casefold() for e in entries}
    if len(entries) > MOST_ENTRIES or not {"[content_types].xml", "word/document.xml"} <= names:
        return "malformed_docx"
    if any(e.flag_bits & 1 for e in entries):
        return "password_protected_document"
    if any("vbaproject.bin" in n or n.endswith((".zip", ".rar", ".7z")) for n in names):
        return "macro_or_archive_document"
    packed, expanded = sum(max(e.compress_size, 1) for e in entries), sum(e.file_size for e in entries)
    if expanded > packed * MOST_EXPANSION or expanded > MOST_EXPANDED:
        return "zip_bomb_suspected"
    try:
        archive.read(next(e for e in entries if e.filename.casefold() == "word/document.xml"))
    except (zipfile.BadZipFile, NotImplementedError, OSError, zlib.error):
        return "malformed_docx"
    return None


def read_uploads(spark: SparkSession, path: str, types: DataFrame) -> DataFrame:
    """Files below a path as uploads (filename, content, size), with the type that `types` (filename, declared_type) states."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "content", F.col("length").alias("size"))
    return named.join(types, "filename", "left")


def checked(uploads: DataFrame, most_bytes: int = 10_000_000, most_pages: int = 50) -> DataFrame:
    """uploads (filename, declared_type, content) with detected_type, page_count and rejection (null if accepted).

    The first fault counts: name, size, emptiness, format, then what the content says. Content of the two formats is
    looked at in batches; what an expression can reject is not. A null content is empty.
    """
    name, size = F.col("filename"), F.coalesce(F.octet_length("content"), F.lit(0))
    suffix = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"[^/.](\.[^./]+)$", 1))
    declared = F.lower(F.btrim(F.split(F.coalesce("declared_type", F.lit("")), ";", 2)[0]))
    start: Column = F.substring("content", 1, 5)
    is_pdf, is_docx = suffix == ".pdf", suffix == ".docx"
    plain = (
        F.when(F.coalesce(F.length(name), F.lit(0)) == 0, "invalid_filename").when(F.length(name) > 255, "invalid_filename").when(size > most_bytes, "file_too_large").when(size == 0, "empty_file")
        .when(~(is_pdf | is_docx) | ~declared.isin(PDF, DOCX), "unsupported_format")
        .when(is_pdf & ((declared != PDF) | (start != F.lit(b"%PDF-"))), "mime_or_magic_mismatch")
        .when(is_docx & ((declared != DOCX) | (F.substring("content", 1, 4) != F.lit(b"PK\x03\x04"))), "mime_or_magic_mismatch")
    )

    @F.arrow_udf("struct<pages long, code string>")
    def looked_at(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for contents in batches:
            pages, codes = [], []
            for c in contents.to_pylist():
                found, code = (None, None) if c is None else pdf_result(c, most_pages) if c[:5] == b"%PDF-" else (None, docx_result(c))
                pages.append(found)
                codes.append(code)
            yield pa.StructArray.from_arrays([pa.array(pages, pa.int64()), pa.array(codes, pa.string())], names=["pages", "code"])

    staged = uploads.withColumn("_plain", plain)
    staged = staged.withColumn("_seen", looked_at(F.when(F.col("_plain").isNull(), F.col("content"))))
    rejection = F.coalesce("_plain", "_seen.code")
    detected = F.when(rejection.isNull(), F.when(is_pdf, PDF).otherwise(DOCX))
    return staged.select(*uploads.columns, detected.alias("detected_type"), F.col("_seen.pages").alias("page_count"), rejection.alias("rejection"))
