"""Pages of files as partitions of a data source, with a fake reader."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lodestone.sources.pdf import FilteredPdfPagesReader, PdfError, pdf_pages, styled_lines


def opener():
    """A file is JSON: its pages, each a list of texts. Made here, so that it is sent to workers, which don't know this module."""

    class Fake:
        def __init__(self, content):
            if content.startswith(b"bad"):
                raise PdfError("PDF_MALFORMED")
            self.pages = json.loads(content)
            self.page_count = len(self.pages)

        def spans(self, page):
            for i, text in enumerate(self.pages[page]):
                yield i, 0, text, 10.0, False

    return Fake


def test_a_long_file_is_several_tasks(spark, tmp_path):
    folder = tmp_path / "raw"
    (folder / "sub").mkdir(parents=True)
    long = [[f"page {i} line {k} " + "x" * 200 for k in range(3)] for i in range(50)]
    (folder / "long.pdf").write_text(json.dumps(long))
    (folder / "sub" / "short.PDF").write_text(json.dumps([["one"]]))
    (folder / "bad.pdf").write_text("bad" + "x" * 9000)
    (folder / "notes.txt").write_text("none")
    uri = f"file://{folder}"
    spark.dataSource.register(pdf_pages(opener(), "fake_pdf"))
    rows = spark.read.format("fake_pdf").option("range_bytes", 4000).load(uri)
    got = rows.withColumn("task", F.spark_partition_id()).collect()
    mine = [r for r in got if r.path.endswith("long.pdf")]
    assert sorted((r.page, r.line, r.text) for r in mine) == [(i + 1, k, t) for i, page in enumerate(long) for k, t in enumerate(page)]
    assert len({r.task for r in mine}) == -(-(folder / "long.pdf").stat().st_size // 4000) > 5
    assert [(r.error_code, r.page) for r in got if r.path.endswith("bad.pdf")] == [("PDF_MALFORMED", None)]
    assert [r.error_code for r in spark.read.format("fake_pdf").option("max_pages", 9).load(uri).where("error_code LIKE '%PAGES'").collect()] == ["PDF_TOO_MANY_PAGES"]
    assert styled_lines(rows).where("error_code IS NULL").count() == 151
    assert spark.read.format("fake_pdf").load(f"file://{tmp_path}/none").count() == 0


def test_filters_on_the_path_are_pushed(spark, tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringStartsWith

    for name in ("a", "b", "c"):
        (tmp_path / f"{name}.pdf").write_text(json.dumps([[name]]))
    uri = f"file://{tmp_path}"

    def planned(*filters):
        reader = FilteredPdfPagesReader(uri, opener(), 1 << 20, 500)
        left = list(reader.pushFilters(list(filters)))
        return [p.path.rpartition("/")[2] for p in reader.partitions()], left

    over = GreaterThan(("page",), 1)
    assert planned(EqualTo(("path",), f"{uri}/b.pdf"), over) == (["b.pdf"], [over])
    assert planned(In(("path",), (f"{uri}/a.pdf", f"{uri}/c.pdf")), StringStartsWith(("path",), f"{uri}/c")) == (["c.pdf"], [])
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        spark.dataSource.register(pdf_pages(opener(), "fake_pdf"))
        rows = spark.read.format("fake_pdf").option("pushdown", "true").load(uri).where(F.col("path") == f"{uri}/b.pdf")
        assert [r.text for r in rows.collect()] == ["b"]
        assert rows.rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
