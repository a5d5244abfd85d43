"""Long texts are searched to their end."""

from lograft import registry
from lograft.operators import spans


def test_spans_after_10240_characters(spark):
    rows = spark.createDataFrame([(1, "x " * 6000 + "10.1.2.3")], "seq long, message string")
    assert [x.start for x in spans.annotated(rows).where("entity = 'ip'").collect()] == [12000]
    assert spans.annotated(rows, depth=10_240).where("entity = 'ip'").count() == 0


def test_paths_after_10240_characters(spark, tmp_path):
    spark.createDataFrame([(1, "<p>" * 5000 + " /srv/www/a.html $12 ")], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert [x.text for x in registry.QUERIES["x31_paths_in_whole_pages"](spark, str(tmp_path)).collect()] == ["/srv/www/a.html"]
    assert [x.text for x in registry.QUERIES["x31_paths_in_pages"](spark, str(tmp_path)).collect()] == ["$12", "$1"]
