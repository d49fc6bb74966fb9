"""Hand-made cases of the document operators, with a wrong variant for the subtle ones."""

import pytest
import regex
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from glyphmill.functions import run_ids, unicode
from glyphmill.operators import clustering, joins, layout, measures, pages, recipes, search, verdicts

GLYPH = "line int, ord int, ch string, x double, advance double, em double, font_id int, rise double, visible boolean, fill_color string"


def cluster(spark, *second):
    """Texts of the runs of A at 0 and the given glyphs, each a dict of what differs."""
    base = dict(line=0, ch="A", x=0.0, advance=10.0, em=12.0, font_id=0, rise=0.0, visible=True, fill_color="k")
    rows = [base | {"ord": 0}] + [base | {"ch": "B", "ord": i, "x": 10.0 * i} | s for i, s in enumerate(second, 1)]
    names = [c.split()[0] for c in GLYPH.split(", ")]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], GLYPH)
    out = clustering.display(clustering.islands(df, ["line"]), ["line", "island"])
    return [r.text for r in out.orderBy("island").collect()]


@pytest.mark.parametrize(
    "change, want",
    [
        ({"font_id": 1}, ["A", "B"]), ({"em": 13.0}, ["A", "B"]), ({"em": 12.05}, ["AB"]), ({"rise": 7.0}, ["A", "B"]), ({"rise": 3.0}, ["AB"]), ({"visible": False}, ["A", "B"]),
        ({"fill_color": "r"}, ["A", "B"]), ({"x": 12.4}, ["A B"]), ({"x": 10.6}, ["AB"]), ({"x": 16.0}, ["A", "B"]), ({"x": 7.0}, ["A", "B"]), ({"x": 8.0}, ["AB"]),
    ],
)
def test_break_rules(spark, change, want):
    assert cluster(spark, change) == want


def test_fragments_isolate_bad_glyphs(spark):
    rows = [(0, i, c, 10.0 * i, 10.0, 12.0) for i, c in enumerate("ab?cd??e")]
    df = clustering.islands(spark.createDataFrame(rows, "line int, ord int, ch string, x double, advance double, em double"), ["line"])
    out = clustering.display(clustering.fragments(df, ["line"], F.col("ch") == "?"), ["line", "island", "fragment"])
    assert [r.text for r in out.orderBy("fragment").collect()] == ["ab", "?", "cd", "?", "?", "e"]


def test_as_of_keeps_a_null_in_the_latest_row(spark):
    left = spark.createDataFrame([(1, 5, 1), (1, 15, 2), (1, 25, 3), (2, 5, 4)], "k int, at int, id int")
    right = spark.createDataFrame([(1, 5, "a"), (1, 15, None), (2, 6, "z")], "k int, at int, v string")
    got = {r.id: r.as_of_v for r in joins.as_of(left, right, ["k"], "at", "v", "id").collect()}
    assert got == {1: "a", 2: None, 3: None, 4: None}


def test_first_range_wins_and_default(spark):
    rows = spark.createDataFrame([("f", i) for i in (0, 5, 10, 11, 99)] + [("g", 5), ("none", 5)], "font string, cid int")
    ranges = spark.createDataFrame([("f", 1, 5, 10, 300), ("f", 2, 0, 10, 200), ("g", 1, 0, 5, 70)], "font string, ord int, first int, last int, width int")
    got = {(r.font, r.cid): r.width for r in joins.range_lookup(rows, ranges, ["font"], F.col("cid"), 1000).collect()}
    assert got == {("f", 0): 200, ("f", 5): 300, ("f", 10): 300, ("f", 11): 1000, ("f", 99): 1000, ("g", 5): 70, ("none", 5): 1000}


def test_anchored_fold_is_not_a_chain(spark):
    got = spark.range(1).select(layout.anchored(F.array(*[F.lit(float(v)) for v in (0, 0.4, 0.8, 1.2)]), 0.5).alias("a")).first().a
    assert got == [0.0, 0.8]  # a chain of neighbours would keep 0 alone


def test_coverage_of_segments(spark):
    def hole_free(segments):
        pieces = F.array_sort(F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for a, b in segments]))
        return spark.range(1).select(layout.uncovered(pieces, F.lit(0.0), F.lit(10.0))).first()[0] <= 0.5

    assert hole_free([(0, 4), (4.3, 10)]) and not hole_free([(0, 4), (5, 10)]) and hole_free([(0, 9.6)])
    assert hole_free([(0, 8), (1, 2), (8.2, 12)]) and not hole_free([(1, 10)]) and not hole_free([(0, 3), (9, 12)]) and hole_free([(-5, 20), (11, 12)])


def grid(spark, *lines):
    df = spark.createDataFrame([(1, *map(float, r)) for r in lines], "page int, x double, y double, dx double, dy double")
    return layout.grids(df, ["page"]).first()


def test_grids(spark):
    box = [(0, 0, 10, 0), (0, 5, 10, 0), (0, 9, 10, 0), (0, 0, 0, 9), (10, 0, 0, 9)]
    g = grid(spark, *box, (4, 0, 0, 9), (0, 5.2, 10, 0))
    assert (g.xs, g.ys, g.reason) == ([0, 4, 10], [0, 5, 9], None)
    assert grid(spark, *box, (4, 0, 0, 4)).reason == "ambiguous-table-grid"
    assert grid(spark, *box[:3]).reason == "unsupported-table-rulings"
    assert grid(spark, *[(0, 2 * i, 10, 0) for i in range(70)], (0, 0, 0, 138), (10, 0, 0, 138)).reason == "table-work-limit"


def test_coverage_never_sums_areas(spark):
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 50.0, 100.0)] * 3 + [(2, 200.0, 0.0, 300.0, 9.0)], "page_id int, x0 double, y0 double, x1 double, y1 double")
    crop = spark.createDataFrame([(1, 0, 0, 100, 100), (2, 0, 0, 100, 100), (3, 0, 0, 0, 0)], "page_id int, px0 int, py0 int, px1 int, py1 int")
    assert {r.page_id: r.coverage for r in measures.coverage(boxes, crop).collect()} == {1: 0.5, 2: 0.0, 3: 0.0}


def test_literal_search(spark):
    df = spark.createDataFrame([("Cat cat scatter",), ("a.b a+b",), ("",), ("aaaa",)], "text string")

    def starts(needle, **kw):
        return [r.o for r in df.select(search.offsets(F.col("text"), needle, **kw).alias("o")).collect()]

    assert starts("cat") == [[0, 4, 9], [], [], []]
    assert starts("cat", match_case=True)[0] == [4, 9]
    assert starts("a.b")[1] == [0] and starts("a+b")[1] == [4]
    assert starts("") == [[], [], [], []] and starts("aa")[3] == [0, 2]
    odd = spark.createDataFrame([("xİİ the end",), ("ẞTHE\U0001f600the",), ("K kelvin k",)], "text string")
    assert [[(r.start, r.match) for r in search.find_matches(odd.where(F.col("text") == t), "the").collect()] for t in ("xİİ the end", "ẞTHE\U0001f600the")] == [[(4, "the")], [(1, "THE"), (5, "the")]]
    assert [r.t for r in odd.select(search.replace_all(F.col("text"), "the", "A").alias("t")).collect()] == ["xİİ A end", "ẞA\U0001f600A", "K kelvin k"]
    many = spark.range(1).select(F.repeat(F.lit("ab,"), 30_000).alias("text"))
    assert many.select(search.offsets(F.col("text"), "B").alias("o")).first().o == [3 * i + 1 for i in range(30_000)]
    row = search.find_matches(spark.createDataFrame([("x" * 60 + "cat" + "y" * 60,)], "text string"), "cat").first()
    assert row.before == "…" + "x" * 48 and row.after == "y" * 48 + "…"


def test_refusals_in_order(spark):
    df = spark.createDataFrame([("not_editable", "", False, 2), ("not_editable", "Type3", True, 2), ("not_editable", "", True, 1), ("editable_original", "", True, 2), ("editable_substitution", "", True, 1)], "state string, reason string, safe boolean, n int")
    got = [r.r for r in df.select(search.refusal(F.col("state"), F.col("reason"), F.col("safe"), F.col("n")).alias("r")).collect()]
    assert got == ["normalization_boundary_unreplaceable", "Type3", "uneditable", "operator_shared_by_multiple_runs", None]


def test_projection():
    text, spans = unicode.project("\ufb01\u00df\U0001f600\u00e9")
    assert text == "fiss\U0001f600e\u0301"
    assert spans == [(0, 1), (0, 1), (1, 2), (1, 2), (2, 4), (2, 4), (4, 5), (4, 5)]
    assert unicode.project("q̣̇")[0] == unicode.project("q̣̇")[0]
    assert [m[:2] for m in unicode.find("STRASSE straße", "straße")] == [(0, 7), (8, 14)]
    assert [m[3] for m in unicode.find("\ufb01x", "f")] == [False]  # half a ligature
    assert [m[3] for m in unicode.find("éa", "e")] == [False]  # half a grapheme
    assert [m[0] for m in unicode.find("Cat cat scatter", "cat", whole_words=True)] == [0, 4]
    assert unicode.find("abc", "") == []


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=30))
def test_projection_spans_cover_the_text(text):
    shown, spans = unicode.project(text)
    assert len(spans) == unicode.units(shown)
    assert all(0 <= s < e <= unicode.units(text) for s, e in spans)


@settings(max_examples=60, deadline=None)
@given(st.text("aAbB \r\n.", max_size=30), st.text("aAb.", min_size=1, max_size=3))
def test_plain_texts_are_found_like_any(text, needle):
    other = unicode.find(text + "\u00e9", needle)  # one character beyond ASCII takes the general way
    assert unicode.find(text, needle) == other
    assert unicode.project(text)[1] == unicode.project(text + "\u00e9")[1][: len(text)]


def test_run_id_with_all_parts(spark):
    h = "ab" * 32
    df = spark.createDataFrame([(h, 3, 1, 99, [7, 12], 2, "On.1", 4, "A_b", 2, 5), (h, 0, 0, 0, [], None, None, None, None, None, None)], "h string, p int, c int, o int, x array<int>, ai int, s string, t int, y string, ga int, gb int")
    names = ("h", "p", "c", "o", "x", "ai", "s", "t", "y", "ga", "gb")
    out = df.select(run_ids.encode(*[F.col(n) for n in names]).alias("id")).select("id", run_ids.decode(F.col("id")).alias("p")).collect()
    assert [r.id for r in out] == [f"{h}:p3:c1/x7/x12/a2:On.1/t4/yA_b:o99:g2-5", f"{h}:p0:c0:o0"]
    assert out[0].p.asDict() == dict(source_hash=h, page=3, part=1, xobj_path=[7, 12], annot_idx=2, annot_state="On.1", pattern=4, charproc="A_b", byte_offset=99, g_start=2, g_end=5)
    bad = spark.createDataFrame([(f"{h}:p0:c0:o0\n",), (None,)], "id string").select(run_ids.is_valid(F.col("id")).alias("v"), run_ids.decode(F.col("id")).alias("p")).collect()
    assert [(r.v, r.p) for r in bad] == [(False, None), (False, None)]


@pytest.mark.parametrize("original, shaped, gaps, want", [(10, 9, 0, "trailing_kern"), (10, 12, 0, "trailing_kern"), (10, 14, 3, "inter_word_kern"), (50, 55, 0, "tz"), (50, 60, 0, "refused"), (50, 20, 1, "trailing_kern")])
def test_fit_ladder(spark, original, shaped, gaps, want):
    assert spark.range(1).select(verdicts.fit(F.lit(float(original)), F.lit(float(shaped)), F.lit(3.0), F.lit(gaps))).first()[0] == want


def test_run_box(spark):
    ctm = F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, -1.0, 0.0, 100.0)])
    box = spark.range(1).select(pages.run_box(F.lit(10.0), F.lit(50.0), F.lit(10.0), F.lit(10.0), ctm).alias("b")).first().b
    assert (box.left, round(box.bottom, 6), round(box.right, 6), round(box.top, 6)) == (10.0, 48.0, 10.01, 58.0)
    flat = F.array(*[F.lit(0.0)] * 6)
    assert spark.range(1).select(pages.run_box(F.lit(1.0), F.lit(1.0), F.lit(2.0), F.lit(1.0), flat)).first()[0] is None


def test_a_document_keeps_its_last_page(spark):
    df = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "doc int, page int")
    assert sorted(map(tuple, pages.delete(df, ["doc"], F.lit(True)).collect())) == [(1, 0), (1, 1), (2, 0)]


def test_incremental_index(spark, tmp_path):
    from glyphmill.streaming import indexing

    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    schema = indexing.SCHEMA
    spark.createDataFrame([(1, "a\nb", "en", "s", 3), (None, "x", "en", "s", 1)], schema).write.parquet(src)
    indexing.index_new(spark, src, out)
    assert (indexing.indexed(spark, out).count(), indexing.failed(spark, out).count()) == (2, 1)
    indexing.index_new(spark, src, out)
    assert indexing.indexed(spark, out).count() == 2
    spark.createDataFrame([(2, "c", "en", "s", 1), (3, None, "en", "s", 0)], schema).write.mode("append").parquet(src)
    indexing.index_new(spark, src, out)
    assert (indexing.indexed(spark, out).count(), indexing.failed(spark, out).count()) == (3, 2)
    again = indexing.retry_failed(spark, out, spark.createDataFrame([(3, "d\ne", "en", "s", 3), (9, "no", "en", "s", 2)], schema))
    assert again.count() == 2


def test_docx_package(spark):
    import io
    import zipfile

    from glyphmill.operators import docx

    rows = [(1, 0, 1, "heading", 1, "A & B"), (1, 0, 2, "list", None, "- x\r\ny"), (1, 1, 1, "paragraph", None, "<z>"), (2, 0, 1, "paragraph", None, "bad \x01")]
    df = spark.createDataFrame(rows, "doc int, page int, ord int, kind string, level int, text string")
    got = {r.doc: r for r in docx.documents(df, "doc").collect()}
    assert got[2].content is None and got[2].reason == "illegal character"
    z = zipfile.ZipFile(io.BytesIO(bytes(got[1].content)))
    xml = z.read("word/document.xml").decode()
    assert "A &amp; B" in xml and "&lt;z&gt;" in xml and 'w:type="page"' in xml and xml.count("<w:p>") == 4
    assert all(i.date_time == docx.DATE for i in z.infolist())
    assert docx.documents(df.repartition(5), "doc").where("doc = 1").first().crc == got[1].crc
    assert [(r.page_count, r.has_text, r.tables) for r in docx.facts(df, "doc").orderBy("doc").collect()] == [(2, True, 0), (1, True, 0)]


def test_grids(spark):
    def lines(page, xs, ys, short=0.0):
        h = [(page, float(xs[0]), float(y), float(xs[-1] - xs[0]) - short, 0.0) for y in ys]
        return h + [(page, float(x), float(ys[0]), 0.0, float(ys[-1] - ys[0])) for x in xs]

    rows = lines(1, (0, 10, 20.0), (0, 5, 9)) + [(1, 10.3, 0.0, 0.0, 9.0)] + lines(2, (0, 10, 20), (0, 5, 9), short=4) + [(3, 0.0, 0.0, 5.0, 0.0)]
    g = layout.grids(spark.createDataFrame(rows, "page int, x double, y double, dx double, dy double"), ["page"])
    got = {r.page: (r.xs, r.ys, r.reason) for r in g.collect()}
    assert got[1] == ([0, 10, 20], [0, 5, 9], None)
    assert got[2][2] == "ambiguous-table-grid" and got[3][2] == "unsupported-table-rulings"
    cells = layout.cells(g, ["page"]).collect()
    assert sorted((r.row, r.col, r.cx0, r.cy0, r.cx1, r.cy1) for r in cells) == [(0, 0, 0, 0, 10, 5), (0, 1, 10, 0, 20, 5), (1, 0, 0, 5, 10, 9), (1, 1, 10, 5, 20, 9)]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(st.text("ab\U0001f600", max_size=12), st.integers(0, 3)), min_size=1, max_size=20))
def test_text_verdict_against_all_places(spark, rows):
    cases = []
    for text, k in rows:
        places = [i for i in range(len(text)) if text.startswith("ab", i)]
        one = [text[:i] + "b" + text[i + 2 :] for i in places]
        after = {0: one[-1] if one else text, 1: text, 2: text.replace("ab", "b"), 3: text + "b"}[k]
        cases.append((text, after, "unverifiable" if not places else "replaced" if after in one else "wrong"))
    df = spark.createDataFrame(cases, "before string, after string, want string")
    for r in df.select("*", search.text_verdict(F.col("before"), F.col("after"), "ab", F.lit("b")).alias("got")).collect():
        assert r.got == r.want, r


def test_recipes_touch_their_own_source_only(spark):
    runs = spark.createDataFrame([("s", "r1", "a"), ("s", "r2", "b"), ("other", "r1", "c"), ("twice", "r1", "d")], "source string, run_id string, text string")
    plan = spark.createDataFrame([("s", "r1", "A", True), ("twice", "r1", "X", True), ("twice", "r1", "Y", True)], "source string, run_id string, new_text string, ok boolean")
    assert {(r.source, r.run_id): r.text for r in recipes.apply(runs, plan).collect()} == {("s", "r1"): "A", ("s", "r2"): "b", ("other", "r1"): "c", ("twice", "r1"): "d"}
    ops = spark.createDataFrame([("s", 0, "r2", "n"), ("s", 1, "r9", "m"), ("new", 0, "r1", "k")], "source string, pos int, run_id string, new_text string")
    old = spark.createDataFrame([("s", 4, "r2", "o"), ("other", 0, "r9", "p")], "source string, pos int, run_id string, new_text string")
    assert {tuple(r) for r in recipes.upsert(old, ops).collect()} == {("s", 4, "r2", "n"), ("other", 0, "r9", "p"), ("s", 5, "r9", "m"), ("new", 0, "r1", "k")}


def test_sinks_of_spans_tables_and_formats(spark):
    schema = "doc int, page int, ord int, kind string, level int, text string, spans array<struct<text: string, bold: boolean, italic: boolean>>, rows array<array<array<struct<text: string, bold: boolean, italic: boolean>>>>"
    s = lambda t, b=None, i=None: (t, b, i)
    rows = [
        (1, 0, 0, "heading", None, "x", [s("A&"), s("b", True, True)], None), (1, 0, 1, "list", None, "x", [s("1"), s(".  one", True), s(" two")], None), (1, 0, 2, "list", None, "* b", None, None),
        (1, 0, 3, "table", None, None, None, [[[s("h|")], [s("i", None, True)]], [[s("c\nd")], []]]), (1, 1, 0, "paragraph", 3, "it's", None, None), (2, 0, 0, "table", None, None, None, [[[s(" ")]]]),
    ]
    df = spark.createDataFrame(rows, schema)
    body = {f: {r.doc: (r.body, r.has_text) for r in layout.export(df, "doc", f).collect()} for f in layout.SINKS}
    assert body["text"][1] == ("A&b\n1.  one two\n* b\nh|\ti\nc\nd\t\n\f\nit's\n", True) and body["text"][2][1] is False
    assert body["markdown"][1][0] == "# A&amp;***b***\n\n- **one** two\n\n- b\n\n| h\\| | *i* |\n| --- | --- |\n| c<br>d |  |\n\n\n---\n\nit's\n\n"
    html = body["html"][1][0].removeprefix(layout.HTML_HEAD).removesuffix(layout.HTML_TAIL)
    assert html == "<section>\n<h1>A&amp;<em><strong>b</strong></em></h1>\n<ul>\n<li><strong>one</strong> two</li>\n<li>b</li>\n</ul>\n<table><tbody>\n<tr><td>h|</td><td><em>i</em></td></tr>\n<tr><td>c<br>d</td><td></td></tr>\n</tbody></table>\n</section>\n<section>\n<p>it&#x27;s</p>\n</section>\n"
    with pytest.raises(ValueError):
        layout.export(df, "doc", "rtf")


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("aé\u0301\u0323ß\U0001f600ﬁ \n\r'.Ὰͅ가"), max_size=25), st.sampled_from(["a", "é", "ss", "fi", "a a", "\u0301"]), st.booleans())
def test_fast_projection_equals_the_one_by_character(text, needle, match_case):
    shown, low, high = unicode._spans(text, match_case)
    assert (shown, list(zip(low.tolist(), high.tolist()))) == unicode._spans_by_character(text, match_case)
    at = [0]
    for c in shown:
        at.append(at[-1] + unicode.units(c))
    words = {0, len(shown), *(m.start() for m in regex.finditer(r"(?w)\b", shown))}
    want, start, k = [], 0, unicode.project(needle, match_case)[0]
    while (i := shown.find(k, start)) >= 0:
        start = i + len(k)
        if i in words and start in words:
            want.append((int(min(low[at[i] : at[start]])), int(max(high[at[i] : at[start]]))))
    assert [m[:2] for m in unicode.find(text, needle, match_case, whole_words=True)] == want


def test_pages_rise_through_all_groups(spark):
    df = spark.createDataFrame([("1-3;5",), ("1-3;3",), ("2;1",), ("1,1",)], "spec string")
    assert [r.ok for r in df.select(pages.increasing(pages.page_groups(F.col("spec"))).alias("ok")).collect()] == [True, False, False, False]
