import pytest
from pyspark.sql import functions as F

from loomspark.sources.snapshots import SnapshotTable

ROWS = "source string, id int"


def state(table, version=None):
    return sorted((tuple(r) for r in table.read(version).collect()), key=str)


@pytest.fixture
def made(spark, tmp_path):
    table = SnapshotTable(spark, f"file://{tmp_path}/t", ROWS)
    table.replace(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4), ("", 5)], ROWS), "source")
    return table


def test_sources_are_replaced_and_removed_and_old_states_stay(spark, made):
    first = state(made)
    assert first == sorted([("a", 1), ("a", 2), ("b", 3), (None, 4), ("", 5)], key=str)
    made.replace(spark.createDataFrame([("a", 9), ("c", 7)], ROWS), "source", spark.createDataFrame([("b",), (None,)], "source string"))
    assert state(made) == [("", 5), ("a", 9), ("c", 7)]
    assert state(made, 1) == first and made.version() == 2
    assert sorted(r["version"] for r in made.read(versions=True).collect()) == [1, 2, 2]


def test_an_empty_table_reads_as_no_rows(spark, tmp_path):
    table = SnapshotTable(spark, f"file://{tmp_path}/none", ROWS)
    assert state(table) == [] and table.version() == 0 and table.vacuum() == []


@pytest.mark.parametrize("dies", ["in the data", "before the log"])
def test_a_writer_that_dies_leaves_the_old_state(spark, made, monkeypatch, dies):
    before = state(made)
    rows = spark.createDataFrame([("a", 10), ("d", 11)], ROWS)
    with monkeypatch.context() as m:
        if dies == "before the log":
            m.setattr(made, "_append_log", lambda rows: (_ for _ in ()).throw(RuntimeError("killed")))
            bad = rows
        else:
            bad = rows.withColumn("id", F.when(F.col("source") == "d", F.raise_error(F.lit("killed")).cast("int")).otherwise(F.col("id")))
        with pytest.raises(Exception, match="killed"):
            made.replace(bad, "source")
    assert state(made) == before and made.version() == 1
    made.replace(rows, "source")  # the retry
    assert state(made) == sorted([("a", 10), ("d", 11), ("b", 3), (None, 4), ("", 5)], key=str)
    assert len(made.vacuum()) == 1 and len(state(made)) == 5


def test_folders_of_other_parts_are_not_read(spark, made):
    made.replace(spark.createDataFrame([("a", 9)], ROWS), "source")
    plan = made.read().where("source = 'a'")._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan


def test_a_part_by_name_may_be_repeated_and_empty(spark, made):
    for _ in range(2):
        made.commit(spark.createDataFrame([("z", 1)], ROWS), "batch-1")
    made.commit(spark.createDataFrame([], ROWS), "batch-2")
    assert state(made).count(("z", 1)) == 1
    made.commit(None, "", ["batch-1"])
    assert ("z", 1) not in state(made)
