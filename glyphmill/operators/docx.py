"""DOCX sink: a document's blocks as an OOXML package, the same bytes every time."""

from __future__ import annotations

import io
import re
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F, types as T

from glyphmill.operators.layout import whole_blocks

ILLEGAL = re.compile("[^\t\n\r\x20-퟿-�\U00010000-\U0010ffff]")
# The parts that every package has, and the date that ZIP entries start from.
DATE = (1980, 1, 1, 0, 0, 0)
TYPES = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
RELS = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>'
TAIL = "<w:sectPr/></w:body></w:document>"


def _run(span: dict) -> str:
    """A span as a run, with what is known of its style; line feeds become breaks."""
    text = span["text"] or ""
    if ILLEGAL.search(text):
        raise ValueError("illegal character")
    marks = "".join(tag for tag, on in (("<w:b/>", span["bold"]), ("<w:i/>", span["italic"])) if on)
    lines = text.replace("\r\n", "\n").replace("\r", "\n").replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").split("\n")
    body = "<w:br/>".join(f'<w:t xml:space="preserve">{line}</w:t>' for line in lines)
    return "<w:r>" + (f"<w:rPr>{marks}</w:rPr>" if marks else "") + body + "</w:r>"


def _paragraph(spans: list[dict], style: str = "") -> str:
    mark = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{mark}{''.join(map(_run, spans))}</w:p>"


def _table(rows: list[list[list[dict]]]) -> str:
    cells = ("".join(f"<w:tc>{_paragraph(c)}</w:tc>" for c in r) for r in rows)
    return "<w:tbl>" + "".join(f"<w:tr>{c}</w:tr>" for c in cells) + "</w:tbl>"


def package(blocks: list[dict]) -> bytes:
    """The package of blocks (kind, level, page, spans, rows) in order; a page break where the page changes."""
    body, page = [], None
    for b in blocks:
        if page is not None and b["page"] != page:
            body.append('<w:p><w:r><w:br w:type="page"/></w:r></w:p>')
        page = b["page"]
        if b["kind"] == "table":
            body.append(_table(b["rows"] or []))
        else:
            style = {"heading": f"Heading{min(6, max(1, b['level'] or 1))}", "list": "ListParagraph"}.get(b["kind"], "")
            body.append(_paragraph(b["spans"], style))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, part in (("[Content_Types].xml", TYPES), ("_rels/.rels", RELS), ("word/document.xml", HEAD + "".join(body) + TAIL)):
            z.writestr(zipfile.ZipInfo(name, DATE), part)
    return out.getvalue()


RESULT = T.StructType([T.StructField("content", T.BinaryType()), T.StructField("reason", T.StringType())])


@F.arrow_udf(RESULT)
def package_udf(blocks: pa.Array) -> pa.Array:
    rows = []
    for b in blocks.to_pylist():
        try:
            rows.append((package(b or []), None))
        except ValueError as e:
            rows.append((None, str(e)))
    return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], ["content", "reason"])


def documents(blocks: DataFrame, doc: str) -> DataFrame:
    """(doc, content, crc, reason): one package for each document; content is null where a text can't be in XML.

    blocks: doc, page, ord, kind, level, text, and spans and rows where there are any.
    """
    parts = F.array_sort(F.collect_list(F.struct("page", "ord", "kind", "level", "spans", "rows")))
    rows = whole_blocks(blocks).groupBy(doc).agg(parts.alias("b")).select(doc, package_udf("b").alias("r"))
    return rows.select(doc, "r.content", F.crc32("r.content").alias("crc"), "r.reason")


def facts(blocks: DataFrame, doc: str) -> DataFrame:
    """(doc, page_count, has_text, tables): what a review shows before export."""
    return blocks.groupBy(doc).agg(F.countDistinct("page").alias("page_count"), F.bool_or(F.trim("text") != "").alias("has_text"), F.count_if(F.col("kind") == "table").alias("tables"))
