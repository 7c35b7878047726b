"""Small hand-computed cases: what SQL cannot say, and the edges."""

import difflib
import io
import random
import re
import zipfile

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import text as fx
from quillspark.operators import cues, edits, layout, lint, markup, pages, similarity
from quillspark.operators import lines as ln
from quillspark.sources import files, office


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def notes(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "note_id long, text string")


@pytest.mark.parametrize("n, units", [(105, 1), (106, 3), (140, 4), (19, 0)])
def test_units(spark, n, units):
    got = one(spark, similarity.unit_array(F.col("t")), t="".join(chr(97 + k % 26) for k in range(n)))
    assert len(got) == units
    if n == 140:
        assert got[-1] == got[-2]


@pytest.mark.parametrize("text, grams", [("abcd", ["abcd"]), ("abc", ["abc"]), ("", [])])
def test_shingles(spark, text, grams):
    assert one(spark, fx.shingles(F.col("t")), t=text) == grams


def test_scalars(spark):
    assert one(spark, fx.jaccard(fx.shingles(F.lit("abcde")), fx.shingles(F.lit("abcdf")))) == pytest.approx(1 / 3)
    assert [one(spark, fx.parse_ts(F.lit(x))) for x in ("00:01:23,456", "01:23", "x")] == [83.456, 83.0, -1.0]
    assert one(spark, fx.fmt_ts(F.lit(3723.9))) == "01:02:03"
    assert one(spark, fx.page_spec(F.lit("9-7,8,[3]"), F.lit(8))) == [7, 8, 3]
    assert one(spark, fx.page_spec(F.lit("[4, 26, 54, 80]"), F.lit(112))) == [4, 26, 54, 80]
    assert one(spark, fx.join_cjk(F.lit("中"), F.lit("a"))) == "中a"
    assert one(spark, fx.join_cjk(F.lit("a"), F.lit("b"))) == "a b"
    assert one(spark, fx.despeak(F.lit("嗯，我们走，就是，好"))) == "我们走，好"
    assert one(spark, fx.decode_symbols(F.lit(chr(0xF061)), {0x61: "α"})) == "α"
    assert one(spark, fx.valid_keyword(F.lit("720P"))) is False
    assert one(spark, fx.page_label(F.lit(3), F.lit(5))) == "3-5"
    assert one(spark, fx.colour(F.lit("1, 2,3"))) == [1, 2, 3]


def test_fence_kinds(spark):
    n = notes(spark, "```\n~~~\n# x\n```\n# y")
    assert [r["title"] for r in ln.headings(n).orderBy("pos").collect()] == ["x"]
    hidden = ln.matched_code(ln.lines_of(n)).filter("not fence and in_code").collect()
    assert [r["line"] for r in hidden] == ["# x"]


def test_sections_and_body(spark):
    n = notes(spark, "## A\n### B\n## C\nx", "> [!todo] t\n> a\n> b\nplain")
    assert [(r["title"], r["end"]) for r in ln.sections(n).filter("note_id = 0").orderBy("pos").collect()] == [("A", 2), ("B", 2), ("C", 4)]
    assert {r["note_id"]: r["body"] for r in ln.body_text(n).collect()}[1] == "plain"


@pytest.mark.parametrize("times, paras", [([0, 5, 11], 3), ([10, 4, 6], 1)])
def test_gap_is_closed(spark, times, paras):
    c = spark.createDataFrame([(1, k, float(t), "a") for k, t in enumerate(times)], "doc_id long, pos int, t double, text string")
    gaps = spark.createDataFrame([(1, 5.0)], "doc_id long, gap double")
    assert cues.paragraphs(c, gaps).count() == paras


@pytest.mark.parametrize("steps, gap", [([70.0, -1.0], 5.0), ([2.0, 4.0, 10.0], 7.2)])
def test_auto_gap(spark, steps, gap):
    t, rows = 0.0, [(1, 0, 0.0, "")]
    for k, s in enumerate(steps):
        t += s
        rows.append((1, k + 1, t, ""))
    c = spark.createDataFrame(rows, "doc_id long, pos int, t double, text string")
    assert cues.auto_gap(c).first()["gap"] == pytest.approx(gap)


def test_parse_cues(spark):
    srt = "1\n00:00:01,500 --> 00:00:02,000\n<b>hi</b>\nyou\n\n2\n00:00:05.000 --> 00:00:06.000\nbye"
    plain = "intro\n0:01 one\ntwo\n# no\n0:05\nthree\n`00:07` 中\n文"
    d = spark.createDataFrame([(1, srt), (2, plain)], "doc_id long, text string")
    got = [(r["doc_id"], r["t"], r["text"]) for r in cues.parse_cues(d).orderBy("doc_id", "pos").collect()]
    assert got == [(1, 1.5, "hi you"), (1, 5.0, "bye"), (2, 1.0, "one two three"), (2, 7.0, "中文")]
    assert [r["prefix"] for r in cues.lost_prefix(d).collect()] == ["intro"]


def test_math_spans(spark):
    n = notes(spark, "$$a$$ $b$ $c\nd$")
    assert [r["tex"] for r in lint.Lint(n).math_spans().orderBy("k").collect()] == ["a", "b"]


@pytest.mark.parametrize(
    "line, faults",
    [
        ("**工具调用（Tool Calling）**机制", (True, False)),
        ("是**「推理即计算」**：好", (True, False)),
        ("**术语（English）**后面还有**别的加粗**", (False, True)),
        ("**good** and __fine__ x", (False, False)),
        ("fill in ____ here", (False, False)),
        ("***", (False, False)),
    ],
)
def test_emphasis(line, faults):
    assert markup.emphasis_faults(line) == faults


def test_emphasis_rows(spark):
    n = notes(spark, "ok **a** `**（x）**y`\n**a（b）**c\n$x__y__$ and **z**\n____")
    assert [r["pos"] for r in markup.emphasis(n).collect()] == [2]
    assert markup.mask("a `b` $c$ \\* d") == "a xxx xxx xx d"


def test_yaml(spark):
    n = notes(spark, "---\ntags: a b\n---", "---\n- x\n---", "---\na: [\n---", "---\ntags: [x y]\n---", "---\ntags: [x]\n---")
    got = {r["note_id"]: r["rule"] for r in markup.frontmatter_yaml(n).collect()}
    assert got == {0: "tags_string", 1: "frontmatter_not_mapping", 2: "frontmatter_yaml", 3: "tag_with_blank"}


def test_callout_density(spark):
    text = "\n".join(["> [!tip] a"] * 7 + ["x"] * 93)
    assert [r["severity"] for r in lint.Lint(notes(spark, text)).callout_density().collect()] == ["warn"]


def test_insert_refusals(spark):
    n = notes(spark, "## A\nx\n## B\ny", "## A\n## A", "## A\n---\n")
    op = lambda rows: spark.createDataFrame(rows, "note_id long, anchor string, at string, content string")
    got = {r["note_id"]: r for r in edits.insert(n, op([(0, "## A", "end-of-section", "## B\nz"), (1, "## A", "end-of-section", "z"), (2, "## A", "end-of-section", "z")])).collect()}
    assert (got[0]["reason"], got[1]["reason"], got[2]["reason"]) == ("heading exists", "anchor is ambiguous", None)
    assert got[0]["new_text"] == "## A\nx\n## B\ny" and got[2]["rule_line"]
    assert edits.insert(n, op([(0, "## A", "after-heading", "  ")])).first()["reason"] == "empty content"
    assert edits.insert(n, op([(0, "## A", "end-of-section", "new")])).first()["new_text"] == "## A\nx\n\nnew\n\n## B\ny\n"


def test_replace(spark):
    n = notes(spark, "a\n## T\n> q\n\n## U\nz")
    op = spark.createDataFrame([(0, "## T", None, "## T\nnew")], "note_id long, anchor string, until string, content string")
    assert edits.replace(n, op).first()["new_text"] == "a\n## T\nnew\n\n## U\nz\n"


def test_patch(spark):
    n = notes(spark, "one two three", "one two three", "abcd")
    e = spark.createDataFrame([(0, 1, "one", "1\nx"), (0, 2, "three", "3"), (1, 1, "one", "1"), (1, 2, "four", "4"), (2, 1, "abc", "x"), (2, 2, "cd", "y")], "note_id long, edit_no int, old string, new string")
    got = {r["note_id"]: r for r in edits.patch(n, e).collect()}
    assert got[0]["new_text"] == "1\nx two 3" and got[0]["reason"] is None
    assert got[1]["new_text"] == "one two three" and got[1]["failed"] == [2]
    assert got[2]["reason"] == "edits overlap" and got[2]["new_text"] == "abcd"
    d = spark.createDataFrame([(0, "<<<<<<< OLD\na\nb\n=======\nc\n>>>>>>> NEW\n")], "note_id long, text string")
    assert edits.parse_edits(d).select("old", "new").first() == ("a\nb", "c")
    bad = edits.first_bad_line(notes(spark, "l1\nl2\nl3"), spark.createDataFrame([(0, 1, "l1\nlX\nl3")], "note_id long, edit_no int, old string")).first()
    assert (bad["good"], bad["breaks_at"]) == (1, "lX")
    near = edits.closest_lines(notes(spark, "hello world\nother"), spark.createDataFrame([(0, "hello worlt")], "note_id long, needle string")).collect()
    assert [r["line_no"] for r in near] == [1]
    tail = edits.closest_lines(notes(spark, "one\na long line that ends like this\nthat ends like that"), spark.createDataFrame([(0, "> that ends like this")], "note_id long, needle string")).collect()
    assert [(r["line_no"], r["ratio"], r["s"]) for r in tail] == [(2, 1.0, "a long line that ends like this")]


def test_toc_rebuild(spark):
    grouped = "# Top\n\n## 目录\n\n### One\n1. [[#Old]]\n\n---\n\n# One\n## a\n## b\n# Two\n## c\n"
    got = edits.rebuild_toc(notes(spark, grouped, "# T\n## 目录\n- [[#A]]\n\n## A")).orderBy("note_id").collect()
    assert got[0]["new_text"] == "# Top\n\n## 目录\n\n### One\n1. [[#a]]\n2. [[#b]]\n\n### Two\n3. [[#c]]\n\n---\n\n# One\n## a\n## b\n# Two\n## c\n"
    assert got[1]["reason"] == "unknown style"


def test_flatten(spark):
    n = notes(spark, "> [!tip] Short\n>\n> a\n> b\n>\nc\n> [!note] keep")
    assert edits.flatten_callouts(n, ["tip"]).first()["new_text"] == "**Short**\na\nb\nc\n> [!note] keep"
    at = lambda *k: spark.createDataFrame([(0, x) for x in k], "note_id long, line_no int")
    assert edits.flatten_callouts(n, [], at=at(7)).first()["new_text"] == "> [!tip] Short\n>\n> a\n> b\n>\nc\n**keep**"
    got = edits.flatten_callouts(n, [], at=at(7, 3)).first()
    assert got["reason"] == "no callout at that line" and got["new_text"] == n.first()["text"]


def test_snapshots(spark):
    s = spark.createDataFrame([(1, "s1", 1, "a", "x")], "note_id long, stamp string, seq int, text string, sha string")
    first = edits.take_snapshots(s, spark.createDataFrame([(1, "b")], "note_id long, text string"), "s1")
    assert first.select("seq", "text").first() == (2, "b")
    assert edits.take_snapshots(s.unionByName(first), spark.createDataFrame([(1, "b")], "note_id long, text string"), "s2").count() == 0


def test_page_ratio(spark):
    a, b = "the quick brown fox jumps", "the quick brown cat jumps"
    mk = lambda *t: spark.createDataFrame([(1, k + 1, x) for k, x in enumerate(t)], "doc_id long, page_no int, text string")
    got = {r["page_no"]: r for r in pages.compare_pages(mk(a, "same", ""), mk(b, "sa me", "", "n")).collect()}
    want = difflib.SequenceMatcher(None, a.replace(" ", ""), b.replace(" ", ""), autojunk=False).ratio()
    assert got[1]["ratio"] == pytest.approx(want) and got[1]["status"] == "changed"
    assert (got[2]["status"], got[3]["ratio"], got[4]["status"]) == ("same", 1.0, "added")


def test_page_text():
    span = lambda x, y, t, size=10.0, w=10: {"x0": x, "y0": y, "x1": x + w, "y1": y + size, "size": size, "text": t}
    page = lambda spans, bars=(): layout.page_text(pd.DataFrame(spans), pd.DataFrame(bars, columns=["y", "x0", "x1"])).split("\n")
    frac = page([span(10, 0, "a"), span(10, 14, "b"), span(0, 80, "x"), span(10, 78, "2", 5.0, 4), span(30, 80, "z")], [(12.0, 9.0, 21.0)])
    assert frac[0] == "\\frac{a}{b}" and frac[1].startswith("x^{2}")
    assert page([span(0, 0, "ϖ"), span(0, 10, "v")]) == ["\\vec{v}"]
    assert page([span(0, 0, "a"), span(1, 1, "a"), span(30, 0, "a")]) == ["aa"] and page([span(0, 0, " ")]) == [""]


def test_mask():
    text = "a `b$` $c$ $$d\ne$$ \\* f\n```x\n**g**\n```\nh `i\nj` ```k"
    assert markup.mask(text) == "a xxxx xxx xxx\nxxx xx f\nxxxx\nxxxxx\nxxx\nh `i\njxxxxxk"
    assert markup.mask("~~~\n`a`\n$\n~~~ x") == "xxx\nxxx\nx\nxxxxx" and markup.mask("~~~\n`a`\n$") == "~~~\nxxx\n$"


def test_core_falls_back_to_all_strokes(spark):
    """No stroke near both medians: all count; strokes drawn right to left are turned."""
    rows = [(1, 1, "line", 500.0, 0.0, 490.0, 10.0), (1, 1, "line", 0.0, 700.0, 10.0, 710.0), (1, 1, "line", 505.0, 0.0, 515.0, 10.0), (1, 1, "line", 0.0, 705.0, 10.0, 715.0)]
    r = layout.figure_regions(spark.createDataFrame(rows, "doc_id long, page int, kind string, x0 double, y0 double, x1 double, y1 double"), 560.0, 800.0).first()
    assert (r["x0"], r["y0"], r["x1"], r["y1"], r["n"]) == (0.0, 0.0, 515.0, 715.0, 4) and r["core_x0"] is not None and r["n_core"] > 0


def test_search_by_likeness(spark):
    """O1: a note whose stem only resembles the query ranks among the others."""
    n = spark.createDataFrame([(1, "a", "alphabet", "x"), (2, "b", "alfabet", "x"), (3, "c", "zzz", "alphabet"), (4, "d", "zzz", "x")], "note_id long, rel string, stem string, text string")
    got = [(r["note_id"], r["score"]) for r in similarity.find_notes(n, "Alphabet").collect()]
    assert got == [(1, 10), (2, int(5 * difflib.SequenceMatcher(None, "alphabet", "alfabet").ratio())), (3, 1)]


def test_symbols_of_several_characters(spark):
    assert one(spark, fx.decode_symbols(F.col("t"), {0x61: "α", 0x62: "lim"}), t="\uf061\uf062c") == "αlimc"


def test_index_and_join_agree(spark, monkeypatch):
    """Few drafts as an index, many by shuffle: the same pairs."""
    rng = random.Random(9)
    text = lambda: "".join(rng.choice(["ka", "lo", "mi", "ne"]) for _ in range(90))
    base = text()
    mk = lambda k, rows: similarity.units_of(spark.createDataFrame(rows, f"{k} long, text string"), k)
    d, n = mk("d", [(1, base), (2, text()), (3, "|" * 30), (4, "")]), mk("n", [(1, base[10:] + text()), (2, text()), (3, base), (4, "#" * 40)])
    found = lambda: sorted(tuple(r) for r in similarity.similar_units(d, n).select("d", "unit_no", "n", "both", "either").collect())
    index = found()
    monkeypatch.setattr(similarity, "INDEX_GRAMS", -1)
    assert index == found() and len(index) > 3


def test_panels(spark):
    cells = [(1, 1, x, y, True) for x in range(3) for y in range(3)] + [(1, 1, 9, 9, True), (1, 1, 3, 3, True)]
    df = spark.createDataFrame(cells, "doc_id int, page int, gx int, gy int, on boolean")
    got = layout.panels(df, 5, 72).collect()
    assert [(r["x0"], r["y0"], r["x1"], r["y1"]) for r in got] == [(0.0, 0.0, 24.0, 24.0)]
    assert layout.pick_panel(layout.panels(df, 1, 72), 9).first()["x0"] == 54.0


def test_files(spark, tmp_path):
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "h.md").write_text("h")
    (tmp_path / "a.md").write_bytes(b"\xef\xbb\xbf# A")
    (tmp_path / "b.MARKDOWN").write_bytes("中文字".encode("gbk"))
    f = files.read_files(spark, str(tmp_path))
    assert sorted(r["rel"] for r in f.collect()) == ["a.md", "b.MARKDOWN"]
    assert {r["rel"]: r["text"] for r in files.strict_text(f).collect()} == {"a.md": "# A", "b.MARKDOWN": None}
    assert {r["rel"]: r["text"] for r in files.lenient_text(f).collect()} == {"a.md": "# A", "b.MARKDOWN": "中文字"}
    assert files.not_utf8(f).count() == 1
    reg = spark.createDataFrame([('{"vaults": {"i": {"path": "/x/Notes", "open": true}, "j": {"path": "/x/Other"}}}',)], "value string")
    v = files.vault_registry(reg).withColumn("exists", F.lit(True))
    assert [r["name"] for r in files.vault_order(v).collect()] == ["Notes", "Other"]
    assert files.resolve_vault(v, "Oth").first()["path"] == "/x/Other" and files.resolve_vault(v, "t").count() == 0
    assert files.owning_vault(spark.createDataFrame([("/x/Notes/a.md",), ("/y/b.md",)], "path string"), v).orderBy("path").select("vault").collect() == [("/x/Notes",), ("/y",)]


def deck():
    a = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"'
    sp = lambda y, t, ph="": f'<p:sp><p:nvSpPr><p:cNvPr id="1" name="n"/><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:spPr><a:xfrm><a:off x="0" y="{y}"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>'
    table = '<p:graphicFrame><a:graphic><a:graphicData><a:tbl><a:tr><a:tc><a:txBody><a:p><a:r><a:t>h|1</a:t></a:r></a:p></a:txBody></a:tc><a:tc/></a:tr><a:tr><a:tc/></a:tr></a:tbl></a:graphicData></a:graphic></p:graphicFrame>'
    slide = f'<p:sld {a}><p:cSld><p:spTree>{sp(5, "low")}{sp(1, "Head", "<p:ph type=\'title\'/>")}{sp(2, "high")}{sp(9, "12")}<p:grpSp>{sp(0, "in")}</p:grpSp>{table}<m:oMath><m:r><m:t>x+1</m:t></m:r></m:oMath></p:spTree></p:cSld></p:sld>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k in (10, 2):
            z.writestr(f"ppt/slides/slide{k}.xml", slide)
    return out.getvalue()


def test_deck(spark):
    f = spark.createDataFrame([("d.pptx", bytearray(deck()))], "path string, content binary")
    s = office.slides(f).orderBy("slide").collect()
    assert [r["slide"] for r in s] == [2, 10]
    assert s[0]["title"] == "Head" and s[0]["body"] == ["high", "low"]
    assert office.slide_tables(f).first()["markdown"] == "| h\\|1 |  |\n| --- | --- |\n|  |  |"
    assert [r["tex"] for r in office.formulas(f).collect()] == ["x+1", "x+1"]
    assert office.shapes(f).filter("depth = 1").count() == 2


def test_word_file(spark):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, s="": f'<w:p><w:pPr>{s}</w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document {w}><w:body><w:tbl><w:tr><w:tc>{p("c")}</w:tc></w:tr></w:tbl>{p("T", "<w:pStyle w:val=\'Title\'/>")}{p("H", "<w:pStyle w:val=\'Heading 6\'/>")}{p("text")}</w:body></w:document>')
    f = spark.createDataFrame([("d.docx", bytearray(out.getvalue()))], "path string, content binary")
    assert [r["text"] for r in office.docx(f).orderBy("pos").collect()] == ["# T", "###### H", "text", "| c |\n| --- |"]


def test_join_plans(spark):
    """The similarity join pairs units by equal grams only."""
    mk = lambda k: spark.createDataFrame([(1, "abcdefghijklmnopqrstuvwxyz" * 3)], f"{k} long, text string")
    d = similarity.units_of(mk("d"), "d")
    plan = similarity.similar_units(d, similarity.units_of(mk("n"), "n"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in text and "NestedLoop" not in text and plan.count() == d.count()


@settings(max_examples=8, deadline=None)
@given(st.text("abcd。 \n", max_size=300))
def test_units_tile(spark, text):
    """Windows cover every kept part, and Jaccard is symmetric and within 0 to 1."""
    units = one(spark, similarity.unit_array(F.col("t")), t=text)
    assert all(20 <= len(u) <= 105 for u in units)
    a, b = F.lit(text), F.lit(text[::-1])
    x, y = one(spark, fx.jaccard(fx.shingles(a), fx.shingles(b))), one(spark, fx.jaccard(fx.shingles(b), fx.shingles(a)))
    assert x == y and 0 <= x <= 1


def test_stream(spark, tmp_path):
    from quillspark.streaming.cues import stream_segments

    rows = [("d", k, float(t)) for k, t in enumerate((0, 5, 9, 14))]
    spark.createDataFrame(rows, "doc_id string, pos long, t double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id string, pos long, t double").parquet(str(tmp_path / "in"))
    q = stream_segments(stream, 5.0).writeStream.format("memory").queryName("segs").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r["seg"] for r in spark.table("segs").orderBy("pos").collect()] == [0, 1, 1, 2]


def test_drafts_past_the_excerpt(spark):
    """a3: what two long notes share after their first thousand characters counts, as by brute force."""
    rng = random.Random(4)
    words = lambda n: " ".join("".join(rng.choices("bcdfghjklm", k=7)) for _ in range(n))
    tail = words(60)
    texts = [words(150) + "\n\n" + tail, words(150) + "\n\n" + tail, words(150)]
    pairs = [(0, 1), (0, 2)]
    n = notes(spark, *texts)
    got = {(r["draft_id"], r["note_id"]): (r["n_units"], r["n_similar"]) for r in similarity.check_drafts(n.withColumnRenamed("note_id", "draft_id"), n, spark.createDataFrame(pairs, "draft_id long, note_id long")).collect()}

    def units(text):
        out = []
        for p in (re.sub(r"\s+", "", p) for p in re.split(r"\n{2,}", text)):
            out += [] if len(p) < 20 else [p] if len(p) <= 105 else [p[i : i + 70] for i in range(0, len(p) - 69, 35)] + [p[-70:]]
        return [{u[i : i + 4] for i in range(len(u) - 3)} for u in out]

    like = lambda a, b: len(a & b) >= 0.55 * len(a | b)
    assert got == {(d, o): (len(units(texts[d])), sum(any(like(a, b) for b in units(texts[o])) for a in units(texts[d]))) for d, o in pairs}
    assert got[0, 1][1] > 5 and got[0, 2][1] == 0


def test_every_rule(spark):
    """u6, a12: an unknown macro, front matter that is no YAML, emphasis that stays literal."""
    n = notes(spark, "$\\oddmacro$", "---\na: [\n---", "**工具调用（Tool Calling）**机制")
    names = spark.createDataFrame([("frac",)], "name string")
    found = lint.Lint(n).findings(names, names)
    assert sorted((r["note_id"], r["severity"], r["rule"]) for r in found.collect()) == [(0, "warn", "math_macro"), (1, "error", "frontmatter_yaml"), (2, "warn", "emphasis")]
    assert lint.summary(n, found).first().asDict() == {"files": 3, "errors": 1, "warnings": 2, "code": 1}


def test_pages_are_rebuilt_the_same_in_any_order(spark):
    """G1: ties among spans do not hang on the order of the rows, and no page is a data frame of its own."""
    spans = [(d, p, float(x % 23 * 22), float(x % 7 * 6), float(x % 23 * 22 + 18), float(x % 7 * 6 + 9), float(8 + x % 3 * 2), f"s{x}") for d in range(40) for p in range(10) for x in range(0, 400, 7)]
    strokes = [(d, p, "line", 20.0, 12.0, 60.0, 12.0) for d in range(40) for p in range(10)] * 2
    kinds = "doc_id int, page int, {} x0 double, y0 double, x1 double, y1 double"

    def made(s):
        lines = spark.createDataFrame(strokes, kinds.format("kind string,"))
        return layout.rebuild_pages(spark.createDataFrame(s, kinds.format("") + ", size double, text string"), lines)

    plan = made(spans)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "FlatMapCoGroups" not in plan
    got = {(r["doc_id"], r["page"]): r["text"] for r in made(spans).collect()}
    assert len(got) == 400 and len(set(got.values())) == 1
    assert got == {(r["doc_id"], r["page"]): r["text"] for r in made(spans[::-1]).collect()}


def test_paragraphs_of_many_and_of_long_segments(spark):
    """Segments are folded row by row: no data frame a segment, and text without a sentence end is not searched again and again."""
    rows = [(d, k, 100.0 * k, f"a{d}-{k}") for d in range(5) for k in range(40)] + [(9, k, k / 10, "word") for k in range(100_000)]
    c = spark.createDataFrame(rows, "doc_id long, pos int, t double, text string").repartition(7)
    gaps = spark.createDataFrame([(d, 5.0) for d in range(10)], "doc_id long, gap double")
    made = cues.paragraphs(c, gaps, max_para=20, spoken=False)
    assert "FlatMapGroupsInPandas" not in made._jdf.queryExecution().toString()
    got = {(r["doc_id"], r["para_no"]): (r["t"], r["text"]) for r in made.collect()}
    assert len(got) == 201 and all(got[d, k] == (100.0 * k, f"a{d}-{k}") for d in range(5) for k in range(40))
    assert got[9, 0] == (0.0, " ".join(["word"] * 100_000))


def test_transcript_stats_of_many_segments(spark):
    """Statistics need no data frame a segment."""
    rows = [(d, k, 100.0 * k, "word") for d in range(50) for k in range(30)]
    c = spark.createDataFrame(rows, "doc_id long, pos int, t double, text string")
    made = cues.transcript_stats(c, cues.paragraphs(c, max_para=60))
    assert "FlatMapGroupsInPandas" not in made._jdf.queryExecution().toString()
    assert {tuple(r) for r in made.select("n_cues", "n_paras", "avg_len", "duration", "gap").collect()} == {(30, 30, 4, 2900.0, 5.0)} and made.count() == 50


def test_transcript_stats_in_one_pass(spark):
    """Cues are read and dealt out once, each text is cleaned once, and the sums are those of the paragraphs."""
    from quillspark.plans.queries import QUERIES
    from tests.conftest import SMALL

    plan = QUERIES["a6_transcript_stats"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("Exchange hashpartitioning") == 2
    said = ["嗯，我们走，就是，好", "我们走。然后", "", None, "plain words", " \u200b ", "呃 那么 word，、end", "对吧"]
    rows = [(d, k, None if d == 4 and k == 0 else k * (1.5 + d) + 40 * (k % 5 == 4), said[(k * (d + 1)) % 8]) for d in range(7) for k in range(1 + 9 * d)]
    rows += [(None, 0, 1.0, "lost"), (8, 0, 0.0, None), (8, 1, 9.0, " ")]
    c = spark.createDataFrame(rows, "doc_id long, pos int, t double, text string").repartition(5)
    made = cues.paragraphs(c, max_para=12)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("嗯+") == 2  # one pattern between marks, one for the head
    want = cues.transcript_stats(c, made)
    got = cues.transcript_stats(c, max_para=12)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 8
    assert {r["doc_id"]: (r["duration"], r["n_paras"], r["avg_len"]) for r in got.collect()}[8] == (9.0, 0, 0)


@pytest.mark.parametrize("text", ["plain", "嗯，走", "走，嗯，来", "a，、b", "。a", " 这个这个 x", "你知道吧，x", "x 对吧 ", "", None])
def test_despeak_shortcut(spark, text):
    """What the search before the fillers leaves out is what no step would change."""
    out = F.lit(text).cast("string")
    for f in fx.FILLERS:
        out = F.regexp_replace(F.regexp_replace(out, rf"(?U)(?<=[\s\x1C-\x1F，。！？、；：]){f}(?=[\s\x1C-\x1F，。！？、；：])", ""), rf"\A{f}(?=[，、])", "")
    want = fx.strip(F.regexp_replace(F.regexp_replace(out, "[，、]{2,}", "，"), r"\A[，、。]+", ""))
    assert one(spark, fx.despeak(F.lit(text).cast("string"))) == one(spark, want)


def test_toc_rebuild_needs_no_shuffle(spark):
    """M5: a note is rebuilt by itself; texts are not dealt out, nor read again for each part of the result."""
    flat = "# T\n## 目录\n1. [[#Old]]\n\n## A\n### a ##\n```\n## code\n```\n## B\n"
    n = notes(spark, flat, "# T\n## A", "", flat.replace("\n", "\r\n"))
    made = edits.rebuild_toc(n)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Scan") == 1
    got = {r["note_id"]: r for r in made.collect()}
    want = "# T\n## 目录\n\n1. [[#A]]\n  1.1 [[#a]]\n2. [[#B]]\n\n## A\n### a ##\n```\n## code\n```\n## B\n"
    assert got[0]["new_text"] == got[3]["new_text"] == want and got[0]["reason"] is None
    assert (got[1]["reason"], got[2]["reason"], got[2]["new_text"]) == ("no contents section", "no contents section", "")
    assert "[[#B]]" not in {r["note_id"]: r for r in edits.rebuild_toc(n, exclude="^B").collect()}[0]["new_text"]


def test_texts_are_read_in_python_as_by_columns(spark):
    """What drafts are checked by equals the column functions, on odd texts too."""
    import random

    from quillspark.functions import text as fx

    r = random.Random(11)
    bits = ["# a", "## 相关链接", "#", " \t# b ##", "> [!TODO] x", "> q", ">", "> [!tip] y", "```", "~~~", "`c`", "$", "$$", "[[x]]", "![[x", "]]", "![a](b)", "<!--", "-->", "---", "\n---", "。", "一二三四五六七八九十" * 3, "word " * 30, "", "　", "x"]
    ends = ["\n"] * 8 + ["\n\n", "\r\n", "\r", " ", "\x85", "\x1c", " ", ""]
    texts = [("---\n" if r.random() < 0.2 else "") + "".join(r.choice(bits) + r.choice(ends) for _ in range(r.randint(0, 25))) for _ in range(1500)]
    n = notes(spark, *texts)
    plain = {x["note_id"]: x for x in n.select("note_id", fx.strip_md(F.col("text")).alias("t"), similarity.unit_array(fx.strip_md(F.col("text"))).alias("u")).collect()}
    body = {x["note_id"]: x["body"] for x in ln.body_text(n).collect()}
    heads: dict = {}
    for x in ln.headings(n).orderBy("note_id", "pos").collect():
        heads.setdefault(x["note_id"], []).append((x["pos"], x["level"], x["title"]))
    for k, t in enumerate(texts):
        lines = t.splitlines()
        assert fx.plain_md(t) == plain[k]["t"], repr(t)
        assert sorted(similarity._units(plain[k]["t"]).items()) == sorted({u: plain[k]["u"].count(u) for u in plain[k]["u"]}.items()), repr(t)
        assert fx.plain_md("\n".join(ln.body_of(lines))) == body[k], repr(t)
        assert ln.headings_of(lines) == heads.get(k, []), repr(t)


def test_draft_check_deals_texts_out_once(spark, monkeypatch):
    """A3: texts travel to their pair, and nothing made of them does; blocks of units of any size count the same."""
    words = [f"w{k * 7919 % 997}" for k in range(4000)]
    texts = [" ".join(words[k : k + 900]) for k in (0, 300, 880, 2000)] + ["short", None]
    n = notes(spark, *texts[:5])
    pairs = spark.createDataFrame([(a, b) for a in range(6) for b in range(7)], "draft_id long, note_id long")
    made = similarity.check_drafts(n.withColumnRenamed("note_id", "draft_id"), n, pairs)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 4 and "Window" not in plan
    got = {(r["draft_id"], r["note_id"]): r for r in made.collect()}
    assert len(got) == 42 and got[0, 6]["verdict"] == 0 and got[0, 0]["n_similar"] == got[0, 0]["n_units"] > 0 and got[5, 0]["n_units"] == 0
    units = [similarity._units(t or "") for t in texts]
    for size in (1, 5000, similarity.PAIRS):
        monkeypatch.setattr(similarity, "PAIRS", size)
        for a in range(4):
            index = similarity.GramIndex(list(units[a]))
            for b in range(4):
                want = len({k for u in units[b] for k, _, _ in index.matches(u, 0.55)})
                assert similarity.similar_count(units[a], units[b], 0.55) == want
                assert got[a, b]["n_similar"] == sum(v for k, (u, v) in enumerate(units[a].items()) if any(k == x for w in units[b] for x, _, _ in index.matches(w, 0.55)))


def test_matching_blocks_of_long_pages(monkeypatch):
    """As many characters match as with difflib, in pages of any length and make; long ones take no time by their square."""
    import difflib
    import random
    import time

    r = random.Random(2)

    def check(times):
        for _ in range(times):
            letters = r.choice(["ab", "abc", "abcdefgh", "一a\U0001f600"])
            x, y = ("".join(r.choice(letters) for _ in range(r.randint(0, 70))) for _ in "xy")
            y = r.choice([y, x.replace("a", r.choice("aZb")) + y[:5]])
            assert pages.matching(x, y) == sum(m.size for m in difflib.SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks()), (x, y)

    check(100)
    words = ["".join(r.choice("aeioustnrlmd") for _ in range(r.randint(2, 9))) for _ in range(300)]
    long = "".join(r.choice(words) for _ in range(6000))
    began = time.time()
    assert pages.matching(long, long.replace("e", "E")) >= len(long) - long.count("e") - 2000
    assert time.time() - began < 20
    monkeypatch.setattr(pages, "AREA", 9)
    check(600)
    monkeypatch.setattr(pages, "RUNS", 60)
    check(600)


def test_matching_blocks_of_repetitive_pages(monkeypatch):
    """Pages of few words, whose runs are short and very many, are not left to difflib as a whole; many pairs at once match as one by one."""
    import random

    r = random.Random(4)
    matcher = difflib.SequenceMatcher

    def bounded(junk, a, b, autojunk):
        assert len(a) * len(b) <= pages.AREA, (len(a), len(b))
        return matcher(junk, a, b, autojunk=autojunk)

    want = lambda x, y: sum(m.size for m in matcher(None, x, y, autojunk=False).get_matching_blocks())
    words = lambda n, *w: "".join(r.choice(w) for _ in range(n))
    few = ["Thretionor" * 120, "Êaieau" * 150, words(350, "the", "re", "on"), words(1500, "a", "b"), "".join("a" * k + "b" for k in range(40))]
    pairs = [(x, y) for t in few for x, y in ((t, t.replace("e", "E")), (t, t[300:] + t[:300]), (t, t[:400] + "x" + t[410:]))]
    expected = [want(x, y) for x, y in pairs]
    monkeypatch.setattr(pages.difflib, "SequenceMatcher", bounded)
    assert [pages.matching(x, y) for x, y in pairs] == expected
    assert pages.matching("Êaieau" * 1500, "ÊaiEau" * 1500) == 1500 * 5  # no run has six characters, and pairs of four are over a million
    long = words(100_000, "the", "re", "on", "ing")  # all its pairs of equal characters are over a thousand million
    assert len(long) // 2 < pages.matching(long, long.replace("e", "E")) < len(long)
    short = [tuple("".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in "xy") for letters in ("ab", "abc", "abcdefgh", "一a\U0001f600") for _ in range(80)]
    expected = [want(x, y) for x, y in short]
    for area, runs, dense, deep in ((1 << 11, 1 << 20, 8, 64), (0, 1 << 20, 8, 64), (0, 5, 0, 64), (9, 300, 1, 1)):
        for name, value in (("AREA", area), ("RUNS", runs), ("DENSE", dense), ("DEEP", deep)):
            monkeypatch.setattr(pages, name, value)
        assert pages.matched(*zip(*short)).tolist() == expected


def test_pages_are_joined_once(spark, monkeypatch):
    """Ratios come from one join of the versions, whatever groups their pages are compared in."""
    mk = lambda rows: spark.createDataFrame(rows, "doc_id long, page_no int, text string")
    texts = ["", "abc", "a b c", "abd", "the quick brown fox", "the quick brown cat"]
    rows = [(k, n, x, y) for k, x in enumerate([None, *texts]) for n, y in enumerate([None, *texts])]
    compared = pages.compare_pages(mk([(k, n, x) for k, n, x, _ in rows if x is not None]), mk([(k, n, y) for k, n, _, y in rows if y is not None]))
    assert compared._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    got = {(r["doc_id"], r["page_no"]): (r["status"], r["ratio"]) for r in compared.collect()}
    for k, n, x, y in rows[1:]:
        if x is None or y is None:
            assert got[k, n] == ("added" if x is None else "deleted", None)
        else:
            ratio = difflib.SequenceMatcher(None, x.replace(" ", ""), y.replace(" ", ""), autojunk=False).ratio()
            assert got[k, n] == ("changed" if ratio < 0.95 else "same", ratio)
    assert len(got) == len(rows) - 1
    xs, ys = [x for x in texts for _ in texts], texts * len(texts)
    whole = pages._ratios(xs, ys).tolist()
    monkeypatch.setattr(pages, "CHARS", 1)
    assert pages._ratios(xs, ys).tolist() == whole and pages._ratios([], []).tolist() == []
