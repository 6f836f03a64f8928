import io
import zipfile

from pyspark.sql import functions as F

from tessera.operators import uploads
from tessera.operators.uploads import DOCX, PDF


def archive(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in {"[Content_Types].xml": "<Types/>", "word/document.xml": "<w/>", **files}.items():
            if data is not None:
                z.writestr(name, data)
    return out.getvalue()


def pdf(pages=2, extra=b""):
    return b"%PDF-1.7\n" + b"<< /Type /Pages >> " + b"<< /Type /Page >> " * pages + extra + b"\nstartxref\n0\n%%EOF\n"


def test_uploads_are_rejected_by_their_first_fault(spark, tmp_path):
    encrypted = bytearray(archive())
    at = encrypted.index(b"PK\x01\x02")
    while at >= 0:
        encrypted[at + 8] |= 1
        at = encrypted.find(b"PK\x01\x02", at + 4)
    cases = [
        ("good.pdf", PDF, pdf(), None), ("GOOD.PDF", "Application/PDF; charset=x", pdf(50), None), ("many.pdf", PDF, pdf(51), "page_limit_exceeded"), ("none.pdf", PDF, pdf(0), "image_only_or_malformed_pdf"), ("cut.pdf", PDF, pdf()[:-8], "malformed_pdf"),
        ("locked.pdf", PDF, pdf(extra=b"/Encrypt 3 0 R"), "password_protected_document"), ("renamed.pdf", PDF, archive(), "mime_or_magic_mismatch"), ("wrong.pdf", DOCX, pdf(), "mime_or_magic_mismatch"), ("good.docx", DOCX, archive(), None),
        ("renamed.docx", DOCX, pdf(), "mime_or_magic_mismatch"), ("broken.docx", DOCX, b"PK\x03\x04 no archive", "malformed_docx"), ("bare.docx", DOCX, archive(**{"word/document.xml": None}), "malformed_docx"), ("macro.docx", DOCX, archive(**{"word/vbaProject.bin": "x"}), "macro_or_archive_document"),
        ("nested.docx", DOCX, archive(**{"a.ZIP": "x"}), "macro_or_archive_document"), ("bomb.docx", DOCX, archive(**{"word/a.xml": "0" * 3_000_000}), "zip_bomb_suspected"), ("locked.docx", DOCX, bytes(encrypted), "password_protected_document"), ("notes.txt", "text/plain", b"x", "unsupported_format"),
        ("noext", PDF, pdf(), "unsupported_format"), (".pdf", PDF, pdf(), "unsupported_format"), ("empty.pdf", PDF, b"", "empty_file"), ("null.pdf", PDF, None, "empty_file"), ("big.pdf", PDF, pdf(extra=b" " * 20_000), "file_too_large"), ("", PDF, pdf(), "invalid_filename"), (None, PDF, pdf(), "invalid_filename"),
        ("x" * 256 + ".pdf", PDF, pdf(), "invalid_filename"), ("undeclared.pdf", None, pdf(), "unsupported_format"),
    ]
    df = spark.createDataFrame([(n, d, c) for n, d, c, _ in cases], "filename string, declared_type string, content binary").repartition(3)
    got = {(r.filename, r.declared_type): r for r in uploads.checked(df, most_bytes=10_000).collect()}
    assert {k: r.rejection for k, r in got.items()} == {(n, d): want for n, d, _, want in cases}
    assert got["good.pdf", PDF].page_count == 2 and got["good.pdf", PDF].detected_type == PDF and got["good.docx", DOCX].detected_type == DOCX and got["many.pdf", PDF].detected_type is None
    for n, _, c, _ in cases[:9]:
        (tmp_path / n).write_bytes(c)
    types = spark.createDataFrame([(n, d) for n, d, _, _ in cases[:9]], "filename string, declared_type string")
    read = uploads.checked(uploads.read_uploads(spark, str(tmp_path), types))
    assert {r.filename: r.rejection for r in read.collect()} == {n: want for n, _, _, want in cases[:9]} and read.filter(F.col("size") == 0).count() == 0
