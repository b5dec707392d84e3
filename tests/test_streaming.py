"""The stream over an added folder."""

from pyspark.sql import functions as F

from textloom.streaming import novelty


def test_novel_lines(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("one\ntwo match\n")
    rows = novelty.novel_lines(novelty.matching_lines(novelty.added_files(spark, str(folder)), F.contains("content", F.lit("match"))))
    query = rows.writeStream.format("memory").queryName("novel").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        query.processAllAvailable()
        (folder / "b.txt").write_text("match\n")
        query.processAllAvailable()
        assert sorted((r["path"].rsplit("/", 1)[-1], r["line_no"]) for r in spark.table("novel").collect()) == [("a.txt", 2), ("b.txt", 1)]
    finally:
        query.stop()
