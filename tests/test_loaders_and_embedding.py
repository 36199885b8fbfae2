import pytest
from pyspark.sql import functions as F

from loomspark.operators.chunking import document_chunks
from loomspark.sources.loaders import Loader, LoaderRegistry
from loomspark.sources.snapshots import SnapshotTable
from loomspark.streaming.embedding import VECTORS, embed_stream

FILES = "source_id string, source_type string, path string, text string"


def test_loaders_by_source_type_and_a_users_own(spark):
    class ByLine(Loader):
        """A chunk a line."""

        def spans(self, path, text):
            return [(i + 1, i + 1, f"row {i + 1}") for i, line in enumerate(text.splitlines()) if line]

    registry = LoaderRegistry(spark)
    registry.register("table", ByLine)
    files = [("a", "markdown", "a.md", "# One\n" + "alpha " * 60 + "\n\n# Two\n" + "beta " * 60), ("b", "text", "b.txt", "# no heading"), ("c", "code", "c.py", "def one():\n    return 1\n"), ("d", "table", "d.csv", "x\n\ny"), ("e", "markdown", "e.md", None), ("f", "text", "f.txt", " \n")]
    df = spark.createDataFrame(files, FILES)
    got = [(r["path"], r["start_line"], r["end_line"], r["heading"]) for r in registry.load(df).orderBy("path", "start_line").collect()]
    assert got == [("a.md", 1, 2, "One"), ("a.md", 4, 5, "Two"), ("b.txt", 1, 1, ""), ("c.py", 1, 2, "one"), ("d.csv", 1, 1, "row 1"), ("d.csv", 3, 3, "row 3")]
    want = document_chunks(df.where("source_type = 'markdown'").select("path", "text"))
    assert sorted(r["text"] for r in registry.load(df.where("source_type = 'markdown'")).collect()) == sorted(r["text"] for r in want.collect())
    assert spark.sql("SELECT heading FROM load_table('p', 'q')").first()[0] == "row 1"
    assert registry.load(df.where("false")).count() == 0
    with pytest.raises(ValueError, match="no loader for sources of type pdf"):
        registry.load(df.withColumn("source_type", F.lit("pdf")))
    with pytest.raises(Exception, match="both strings"):
        spark.sql("SELECT * FROM load_text('p', 1)").collect()


def test_a_stream_that_fails_half_way_ends_with_each_vector_once(spark, tmp_path):
    table = SnapshotTable(spark, f"file://{tmp_path}/vectors", VECTORS)
    table.commit(spark.createDataFrame([("old", [1.0], "before", 0)], VECTORS), "before/0")
    source = f"{tmp_path}/in"
    for i in range(4):
        spark.createDataFrame([(f"c{i}", f"text {i}"), ("c0", "text 0"), (None, "x"), (f"n{i}", None)], "id string, text string").coalesce(1).write.mode("append").parquet(source)
    broken = {"at": 2, "seen": 0}

    def embed(text):
        broken["seen"] += 1
        vector = F.array(F.length(text).cast("float"))
        return F.when(F.lit(broken["seen"] == broken["at"]), F.raise_error(F.lit("model fell over")).cast("array<float>")).otherwise(vector)

    def run():
        stream = spark.readStream.schema("id string, text string").option("maxFilesPerTrigger", 1).parquet(source)
        embed_stream(stream, table, "hash", embed, f"{tmp_path}/checkpoint").awaitTermination()

    with pytest.raises(Exception, match="model fell over"):
        run()
    first = table.version()
    assert first == 2 and [r["id"] for r in table.read().collect()] != ["old"]
    run()
    rows = sorted((r["id"], r["model"]) for r in table.read().collect())
    assert rows == [(f"c{i}", "hash") for i in range(4)]
    assert table.version() == first + 3
    run()  # nothing new
    assert table.version() == first + 3
