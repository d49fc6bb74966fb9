"""The PDF reader on files made here."""

import zlib

from pyspark.sql import functions as F

from glyphmill.operators import clustering
from glyphmill.sources import pdf


def make(objects: dict[int, bytes], root: int = 1) -> bytes:
    out = b"%PDF-1.7\n"
    for n, body in objects.items():
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    return out + b"trailer << /Root %d 0 R >>\n%%%%EOF" % root


def stream(body: bytes, extra: bytes = b"", flate: bool = True) -> bytes:
    raw = zlib.compress(body) if flate else body
    return b"<< /Length %d %s %s >>\nstream\n%s\nendstream" % (len(raw), b"/Filter /FlateDecode" if flate else b"", extra, raw)


def simple(content: bytes, more: dict[int, bytes] | None = None, xobjects: bytes = b"") -> bytes:
    widths = b" ".join([b"500"] * 224)
    return make({
        1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R 2 0 R] /Count 1 /MediaBox [0 0 300 400] >>",
        3: b"<< /Type /Page /Parent 2 0 R /Contents [4 0 R 5 0 R] /Rotate 450 /Resources << /Font << /F1 6 0 R >> /XObject << %s >> >> >>" % xobjects,
        4: stream(content), 5: stream(b"BT /F1 10 Tf 20 50 Td (second part) Tj ET", flate=False),
        6: b"<< /Type /Font /Subtype /Type1 /BaseFont /ABCDEF+Test /FirstChar 32 /Widths [%s] >>" % widths,
    } | (more or {}))


def write(tmp_path, **files):
    for name, data in files.items():
        (tmp_path / f"{name}.pdf").write_bytes(data)
    return str(tmp_path)


def test_runs_of_a_page(spark, tmp_path):
    body = rb"BT /F1 10 Tf 1 0 0 1 20 300 Tm (Hel\154o) Tj [( wor) -300 (ld)] TJ 3 Tr (hidden) Tj 0 Tr 0 -20 Td <4142> Tj ET 0 0 10 10 re f"
    rows = pdf.content(spark, write(tmp_path, a=simple(body))).cache()
    keys = ["page", "part", "y", "visible"]
    out = clustering.display(clustering.islands(pdf.glyphs(rows).where("ch <> ' '"), keys), [*keys, "island"])
    assert sorted((r.part, r.y, r.visible, r.text) for r in out.collect()) == [(0, 280.0, True, "AB"), (0, 300.0, False, "hidden"), (0, 300.0, True, "Hello"), (0, 300.0, True, "wor ld"), (1, 50.0, True, "part"), (1, 50.0, True, "second")]
    first = rows.where("kind = 'glyph'").orderBy("ord").first()
    assert (first.ch, first.x, first.y, first.dx, first.em, first.font, first.part) == ("H", 20.0, 300.0, 5.0, 10.0, "ABCDEF+Test", 0)
    page = rows.where("kind = 'page'").first()
    assert (page.rotation, page.media_box) == (90, [0.0, 0.0, 300.0, 400.0])
    facts = pdf.page_facts(rows).first()
    assert (facts.visible, facts.invisible, facts.n_paths) == (len("Hello world") + 2 + len("second part"), 6, 2)
    ords = [r.ord for r in rows.where("kind = 'glyph'").orderBy("ord").collect()]
    assert ords == sorted(set(ords))


def test_forms_images_and_cycles(spark, tmp_path):
    more = {
        7: stream(b"q 2 0 0 2 0 0 cm BT /F1 5 Tf (in) Tj ET Q /X Do", b"/Type /XObject /Subtype /Form /Matrix [1 0 0 1 100 0] /Resources << /Font << /F1 6 0 R >> /XObject << /X 7 0 R >> >>"),
        8: stream(b"\0", b"/Type /XObject /Subtype /Image /Width 1 /Height 1"),
    }
    data = simple(b"/X Do q 50 0 0 40 10 20 cm /I Do Q", more, b"/X 7 0 R /I 8 0 R")
    rows = pdf.content(spark, write(tmp_path, b=data)).collect()
    inside = [r for r in rows if r.kind == "glyph" and r.xobj_path == [7]]
    assert [(r.ch, r.x, r.em) for r in inside] == [("i", 100.0, 10.0), ("n", 105.0, 10.0)]
    image = next(r for r in rows if r.kind == "image")
    assert (image.x, image.y, image.dx, image.dy) == (10.0, 20.0, 50.0, 40.0)


def test_refusals(spark, tmp_path):
    bad = make({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] >>", 3: b"<< /Type /Page /Contents 4 0 R >>", 4: b"<< /Length 3 /Filter /LZWDecode >>\nstream\nabc\nendstream"})
    got = pdf.content(spark, write(tmp_path, text=b"no pdf at all", lzw=bad, odd=simple(b"BT Tf (x Tj ET"))).where("kind = 'refused'").select(F.regexp_extract("path", r"(\w+)\.pdf", 1).alias("f"), "ch").collect()
    said = {(r.f, r.ch) for r in got}
    assert {("text", "not a PDF"), ("lzw", "unsupported filter /LZWDecode"), ("odd", "malformed operands of Tf")} <= said


def rulings(spark, tmp_path, **bodies):
    rows = pdf.content(spark, write(tmp_path, **{k: simple(*v) if isinstance(v, tuple) else simple(v) for k, v in bodies.items()})).where("kind = 'ruling'").orderBy("ord").collect()
    return {k: [(r.x, r.y, r.dx, r.dy) for r in rows if r.path.endswith(f"{k}.pdf")] for k in bodies}


def test_what_leaves_rulings_out(spark, tmp_path):
    form = {7: stream(b"0 0 m 9 0 l S", b"/Type /XObject /Subtype /Form")}
    got = rulings(
        spark, tmp_path,
        slanting=b"0 0 m 9 0 l 12 5 l S 0 1 m 9 1 l S", clipped=b"q 0 0 50 50 re W n 1 1 m 1 9 l S q 2 2 m 2 9 l S Q Q 3 3 m 3 9 l S", unbalanced=b"0 0 m 9 0 l S Q", broken=b"0 0 m 9 0 l S 1 m",
        form=(b"/X Do 0 2 m 9 2 l S", form, b"/X 7 0 R"), closed=b"0 0 m 9 0 l 9 9 l s 0 5 m 9 5 l n", nearly=b"0 0 m 9 0.005 l S", nowhere=b"9 0 l S 0 4 m 9 4 l S",
    )
    assert got["slanting"] == [(0, 1, 9, 0)] and got["clipped"] == [(3, 3, 0, 6)] and got["unbalanced"] == got["broken"] == []
    assert got["form"] == [(0, 2, 9, 0)] and got["closed"] == [] and got["nearly"] == [(0, 0, 9, 0.005)] and got["nowhere"] == [(0, 4, 9, 0)]


def test_rulings(spark, tmp_path):
    body = b"q 2 0 0 2 5 5 cm 0 0 m 10 0 l S Q 0 0 20 30 re S 0 0 m 5 5 l S 0 0 m 1 1 2 2 3 0 c S 0 0 50 50 re W n 1 1 m 1 9 l S 0 0 9 9 re f"
    rows = pdf.content(spark, write(tmp_path, r=simple(body))).where("kind = 'ruling'").orderBy("ord").collect()
    assert [(r.x, r.y, r.dx, r.dy) for r in rows] == [(5, 5, 20, 0), (0, 0, 20, 0), (20, 0, 0, 30), (0, 30, 20, 0), (0, 0, 0, 30)]


def texts(spark, tmp_path, **fonts):
    """The characters and widths of each font's strings: (font object, more objects, shown string)."""
    files = {}
    for k, (font, more, shown) in fonts.items():
        objects = {
            1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /MediaBox [0 0 300 400] >>", 3: b"<< /Type /Page /Contents 4 0 R /Resources << /Font << /F1 6 0 R >> >> >>",
            4: stream(b"BT /F1 10 Tf 10 Tw 0 0 Td %s Tj ET" % shown), 6: font,
        }
        files[k] = make(objects | more)
    rows = pdf.content(spark, write(tmp_path, **files)).where("kind IN ('glyph', 'refused')").orderBy("ord").collect()
    return {k: [(r.ch, round(r.dx, 6) if r.dx is not None else None) for r in rows if r.path.endswith(f"{k}.pdf")] for k in fonts}


def test_characters_and_widths_of_fonts(spark, tmp_path):
    to_unicode = stream(b"1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0003> <0041> <0004> <D83DDE00> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<00660069> <03A9>] endbfrange")
    cid = {7: b"<< /Type /Font /Subtype /CIDFontType2 /DW 750 /W [3 [600 400] 16 18 500 40] >>", 8: to_unicode}
    codespace = stream(b"1 begincodespacerange <00> <7F> endcodespacerange 1 begincodespacerange <8000> <FFFF> endcodespacerange")
    got = texts(
        spark, tmp_path,
        composite=(b"<< /Subtype /Type0 /Encoding /Identity-H /DescendantFonts [7 0 R] /ToUnicode 8 0 R >>", cid, b"<0003000400110020002100990020>"),
        named=(b"<< /Subtype /Type0 /Encoding /UniGB-UCS2-H /DescendantFonts [7 0 R] >>", cid, b"<0003>"),
        mixed=(b"<< /Subtype /Type0 /Encoding 9 0 R /DescendantFonts [7 0 R] >>", cid | {9: codespace}, b"<0003>"),
        differing=(b"<< /Subtype /Type1 /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [65 /eacute /uni20AC 90 /Lslash /f_i /nosuchname /A.alt] >> >>", {}, b"(ABCZ[\\\\] \\223)"),
        mac=(b"<< /Subtype /TrueType /Encoding /MacRomanEncoding /FirstChar 128 /Widths [100 200] >>", {}, b"<808182>"),
        standard=(b"<< /Subtype /Type1 >>", {}, b"<2760AEA1>"),
        symbolic=(b"<< /Subtype /Type1 /FontDescriptor << /Flags 4 /MissingWidth 300 >> >>", {}, b"(a )"),
        type3=(b"<< /Subtype /Type3 /FontMatrix [0.01 0 0 0.01 0 0] /FirstChar 97 /Widths [40] /Encoding << /Differences [97 /a] >> >>", {}, b"(a)"),
    )
    assert got["composite"] == [("A", 6.0), ("\U0001f600", 4.0), ("b", 5.0), ("fi", 7.5), ("Ω", 7.5), (None, 7.5), ("fi", 7.5)]
    assert got["named"] == got["mixed"] == [("codes of unknown width", None)]
    assert [c for c, _ in got["differing"]] == ["é", "€", "C", "Ł", "fi", None, "A", " ", "“"]
    assert got["mac"] == [("Ä", 1.0), ("Å", 2.0), ("Ç", 5.0)]
    assert [c for c, _ in got["standard"]] == ["’", "‘", "ﬁ", "¡"]
    assert got["symbolic"] == [(None, 3.0), (None, 13.0)]
    assert got["type3"] == [("a", 4.0)]
