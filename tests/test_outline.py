"""Outline, titles, typography: fixtures written for each rule."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestone.functions.outline import follows, sections, serial
from lodestone.functions.titles import title
from lodestone.operators.typography import is_scanned, markdown_pages, merge_read, pages_to_read


@pytest.fixture
def outlined(spark):
    """Of each page the (heading path, body) sections."""

    def run(*pages):
        rows = sections(spark.createDataFrame([("d", list(pages))], "document_id string, pages array<string>"), F.col("pages")).orderBy("page", "section").collect()
        return [[(r.heading_path or "", r.body) for r in rows if r.page == n] for n in range(1, len(pages) + 1)]

    return run


@pytest.fixture
def paths(outlined):
    return lambda *pages: [[h for h, _ in page] for page in outlined(*pages)]


@pytest.mark.parametrize(("number", "want"), [("10", (10, "")), ("10a", (10, "a")), ("04đ", (4, "đ")), ("IV", (4, "")), ("XIX", (19, "")), ("VIIa", (7, "a")), ("Q", None), ("", None)])
def test_serial(number, want):
    assert serial(number) == want


@pytest.mark.parametrize(("before", "now", "want"), [(None, "1", True), (None, "2", False), ("10", "11", True), ("10", "10a", True), ("10a", "11", True), ("10a", "10b", True), ("10a", "10a", False), ("10", "12", False), ("I", "II", True), ("3", "x", False)])
def test_follows(before, now, want):
    assert follows(before, now) is want


def test_markdown_levels_alone(paths):
    assert paths("# A\na\n## B\nb\n# C\nc") == [["A", "A > B", "C"]]
    assert paths("just text\nmore") == [[""]]
    assert paths("# A\na", "more of a\n## B\nb") == [["A"], ["A", "A > B"]]


def test_a_skipped_level_nests_under_an_equal_one(paths):
    assert paths("# A\nx\n### B\ny\n### C\nz")[0] == ["A", "A > B", "A > B > C"]


CHAPTERS = "# Chapter I\n# Article 1. One\na\n# Article 2. Two\nb\n# Chapter II\n# Article 3. Three\nc\n# Article 4. Four\nd"


def test_depth_comes_from_recurrence(paths):
    found = paths(CHAPTERS)[0]
    assert "Chapter I > Article 2. Two" in found
    assert "Chapter II > Article 3. Three" in found
    assert not any("Article 2. Two > Chapter" in p for p in found)


def test_a_plain_line_has_to_be_next_and_written_alike(paths):
    page = "# Article 1. One\na\n# Article 2. Two\nArticle 9 of the law says so\nArticle 3. Three\nc"
    found = paths(page)[0]
    assert "Article 3. Three" in found
    assert not any("9" in p for p in found)


def test_captions_are_no_structure_but_appendices_are(paths):
    assert not any("Table" in p for p in paths("# Intro\n**Table 1**\nx\n**Table 2**\ny\n# End\nz")[0])
    found = paths("# Article 1. A\na\n# Article 2. B\nb\n**Form 01.** First\nc\n**Form 02.** Second\nd")[0]
    assert "Form 01. First" in found
    assert "Form 02. Second" in found


def test_glued_headings_split_and_masked_numbers_stay(paths, outlined):
    assert any("Part 2" in p for p in paths("# Part 1\nx\n**Part 2****NAMES**\ny")[0])
    assert outlined("# A\ncard 12 **** 34")[0][0][1].endswith("12 **** 34")


def test_a_marker_takes_its_name_from_the_next_line(paths):
    found = paths("# Chapter 1\nGENERAL RULES\na\n# Chapter 2\nTHE REST\nb")[0]
    assert found == ["Chapter 1. GENERAL RULES", "Chapter 2. THE REST"]


def test_a_list_item_that_is_a_heading_ends_at_the_next_item(paths):
    page = "# Step 1\n1. first\n## 2. Second\ninside\n3. third\nafter\n# Step 2\nz"
    found = paths(page)[0]
    assert "Step 1 > 2. Second" in found
    assert found[found.index("Step 1 > 2. Second") + 1] == "Step 1"


def test_an_unnumbered_heading_no_deeper_closes_the_numbered_one(paths):
    assert paths("## Step 1\na\n## Step 2\nb\n## Configuration\nc")[0][-1] == "Configuration"
    assert paths("## Step 1\na\n## Step 2\nb\n### Detail\nc")[0][-1] == "Step 2 > Detail"


def test_a_long_heading_is_a_paragraph(paths):
    assert len(paths("# Step 1\na\n# Step 2\n# " + "word " * 100 + "\nb")[0]) == 2


def test_sections_of_a_table(spark):
    docs = spark.createDataFrame([("d", ["# A\nx", "y\n# B\nz"]), ("e", []), ("f", None)], "document_id string, pages array<string>")
    rows = [tuple(r) for r in sections(docs, F.col("pages")).orderBy("page", "section").collect()]
    assert rows == [("d", 1, 0, "A", "# A\nx"), ("d", 2, 0, "A", "y"), ("d", 2, 1, "B", "# B\nz")]


def test_titles(spark):
    cases = [
        ("A real title", ["text"], "A real title"),
        ("(anonymous)", ["## Lower\ntext"], "Lower"),
        ("scan001.pdf", ["x\n# Big\ny"], "Big"),
        (" 2024-01-02 export", ["x", "# On page two"], "On page two"),
        (None, ["Số: 12/2024/NĐ-CP\n\nNGHỊ ĐỊNH\n\nQuy định chi tiết\n\nCăn cứ Luật"], "Nghị định 12/2024/NĐ-CP quy định chi tiết"),
        (None, ["LUẬT\n\nĐƯỜNG BỘ\n\nLuật Đường bộ số 35"], "Luật Đường bộ"),
        (None, ["<table>x</table>\n**LUẬT**\nQUỐC TỊCH VIỆT NAM\nCăn cứ Hiến pháp"], "Luật Quốc tịch Việt Nam"),
        (None, ["**CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM**\nHà Nội, ngày 1 tháng 2 năm 2024\nQUYẾT ĐỊNH\nVỀ VIỆC TĂNG LƯƠNG\nCHO CÁN BỘ"], "Quyết định về việc tăng lương cho cán bộ"),
        (None, ["THÔNG TƯ\n\n", "y"], "THÔNG TƯ"),
        (None, ["Số: 1\n  ### Not a preamble " + "z" * 300], ("Not a preamble " + "z" * 300)[:200]),
        ("", [], "f.pdf"),
        (None, None, "f.pdf"),
    ]
    rows = spark.createDataFrame([(i, m, p, "f.pdf") for i, (m, p, _) in enumerate(cases)], "i int, m string, p array<string>, f string")
    assert [r[0] for r in rows.orderBy("i").select(title("m", "p", "f")).collect()] == [want for *_, want in cases]


def test_typography(spark):
    lines = [(1, 0, 0, "Big title", 20.0, False), (1, 1, 0, "goes on", 20.0, False), (1, 2, 1, "body text " * 5, 10.0, False), (2, 0, 0, "Chapter", 14.0, True), (2, 1, 1, "Điều 5. Scope", 10.0, True), (2, 2, 1, "more body " * 9, 10.0, False)]
    spans = spark.createDataFrame([("d", *r) for r in lines], "document_id string, page int, line int, block int, text string, size double, bold boolean")
    got = {r.page: r.markdown for r in markdown_pages(spans).collect()}
    assert got[1].splitlines()[0] == "# Big title goes on"
    assert got[2].splitlines()[:2] == ["## Chapter", "### Điều 5. Scope"]


def test_reading_pages(spark):
    one = spark.range(1).select(is_scanned(F.lit(0), F.lit(0)), is_scanned(F.lit(500), F.lit(2)), is_scanned(F.lit(99), F.lit(1))).first()
    assert tuple(one) == (True, False, True)
    pages = spark.createDataFrame([("d", 1, "x" * 300, True, False), ("d", 2, "y" * 300, False, None), ("s", 1, "", False, False)], "document_id string, page int, markdown string, has_table boolean, has_image boolean")
    assert {(r.document_id, r.page): r.to_read for r in pages_to_read(pages).collect()} == {("d", 1): True, ("d", 2): False, ("s", 1): True}
    read = spark.createDataFrame([("d", 1, "read"), ("s", 1, None)], "document_id string, page int, markdown string")
    got = {(r.document_id, r.page): (r.markdown[:4], r.source, r.confidence) for r in merge_read(pages, read).collect()}
    assert got == {("d", 1): ("read", "ocr", 1.0), ("d", 2): ("yyyy", "text", 1.0), ("s", 1): ("", "text", 0.0)}


def test_rules_are_those_of_a_plain_search(spark):
    """Kinds that count, and which stand apart, by trying all stretches of random sequences of headings."""
    import random

    from lodestone.operators.headings import rules

    rng = random.Random(3)
    docs = [(f"d{i}", [(rng.choice("abcd"), rng.random() < 0.6, rng.random() < 0.5) for _ in range(rng.randint(0, 14))], rng.random() < 0.8) for i in range(80)]
    docs += [(f"nested{i}", [(k, True, True) for k in text], True) for i, text in enumerate(("abbabb", "abbabbcc", "abcbcabcbc", "aabbab", "abbabbcbcc", "bbaabbaa"))]
    rows = [(d, any_md, place, k, md and any_md, dot) for d, hs, any_md in docs for place, (k, md, dot) in enumerate(hs)]
    got = {r.d: (set(r.rules.kinds), set(r.rules.dotted), {tuple(p) for p in r.rules.apart}) for r in rules(spark.createDataFrame(rows, "d string, any_markdown boolean, place int, kind string, markdown boolean, dotted boolean").repartition(3), "d").collect()}
    for d, hs, any_md in docs:
        at = {k: [i for i, h in enumerate(hs) if h[0] == k] for k in "abcd"}
        core = {k for k, p in at.items() if len(p) > 1 and (not any_md or any(hs[i][1] for i in p))}
        kinds = core | {k for k, p in at.items() if core and len(p) > 1 and p[0] > max(at[c][-1] for c in core)}
        splits = {(a, b) for a in kinds for b in kinds - {a} if any(sum(p < i < q for i in at[a]) > 1 for p, q in zip(at[b], at[b][1:], strict=False))}
        divided = {(a, b) for a in kinds for b in kinds - {a} if (b, a) in splits and ((a, b) not in splits or at[a][0] < at[b][0])}
        over = {(a, b) for a in kinds for b in kinds - {a} if at[a][0] > at[b][-1] and all(at[c][-1] < at[a][0] for c in kinds - {a, b} if (c, b) in splits)}
        dotted = {k for k in kinds if sum(hs[i][2] for i in at[k]) * 2 > len(at[k])}
        assert got.get(d, (set(), set(), set())) == (kinds, dotted, divided | over), (d, hs)


def test_a_worker_holds_the_lines_of_few_documents_at_a_time(spark, monkeypatch):
    import pyspark.sql.functions as F

    from lodestone.functions import outline as O

    docs = spark.createDataFrame([(i, f"# Part {i}\nbody {i}") for i in range(50)], "document_id long, text string").coalesce(1)
    split = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: split.append(f) or self)
    told = O.sections(docs.select("document_id", F.array("text").alias("pages")), F.col("pages"))
    monkeypatch.undo()
    batch = told.toArrow().combine_chunks().to_batches()[0]
    found = [b.column(0).to_pylist() for b in split[0](iter([batch]))]
    assert batch.num_rows == 50 and max(len(set(ids)) for ids in found) <= 16
    assert sorted({i for ids in found for i in ids}) == list(range(50))
