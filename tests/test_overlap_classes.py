"""Overlaps are found between classes of equal word sets, and every pair of objects is there once."""

import pytest

from lodestar.operators import evaluate as V

ROWS = [(1, ["a", "b"]), (2, ["b", "a", "a"]), (3, ["c"]), (4, ["c", "d"]), (5, []), (6, None), (7, ["a", "b"]), (8, ["e"]), (9, [None, "e"]), (10, [None]), (11, ["x y"])]


def brute(rows: list) -> list:
    sets: dict = {}
    for i, w in rows:
        sets.setdefault(i, set()).update(x for x in w or [] if x is not None)
    return sorted((a, b) for a in sets for b in sets if a != b and sets[a] & sets[b])


@pytest.mark.parametrize("rows", [ROWS, [*ROWS, (1, ["c"]), (3, ["c"])]])
def test_overlap(spark, rows):
    df = spark.createDataFrame(rows, "idx long, w array<string>")
    assert sorted(map(tuple, V.truth_by_overlap(df, "w").collect())) == brute(rows)


def test_no_pairs_of_objects_are_shuffled(spark):
    df = spark.createDataFrame([(i, [f"w{i % 3}", "z"]) for i in range(300)], "idx long, w array<string>")
    found = V.truth_by_overlap(df, "w")
    assert found.count() == 300 * 299
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan


def test_pairs_of_very_many_objects_or_repeated_ids_are_not_shuffled(spark):
    """More than a million objects in three classes; ids that come twice, whose words are put together first."""
    many = spark.range(1_100_000).selectExpr("id AS idx", "array('z', concat('w', id % 3)) AS w")
    twice = spark.createDataFrame([*ROWS, (1, ["c"]), (3, ["e"]), (3, None)], "idx long, w array<string>")
    for df in (many, twice):
        plan = V.truth_by_overlap(df, "w")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and "HashAggregate" not in plan


@pytest.mark.parametrize("broadcast", [True, False])
def test_classes_of_several_arrays(spark, monkeypatch, broadcast):
    monkeypatch.setattr(V, "LENGTH", 3)
    monkeypatch.setattr(V, "MEMBERS", 1_000 if broadcast else 10)
    rows = [(i, [f"w{i % 4}", f"x{i % 3}"]) for i in range(60)] + ROWS[4:6]
    assert sorted(map(tuple, V.truth_by_overlap(spark.createDataFrame(rows, "idx long, w array<string>"), "w").collect())) == brute(rows)


def test_stemmed_overlap_of_parts_that_come_twice(spark, tmp_path):
    from lodestar.plans import registry

    parts = [(1, "blue lace"), (2, "green"), (1, "green peru"), (3, "lace"), (4, "navy"), (5, None), (3, "navy")]
    spark.createDataFrame(parts, "p_partkey long, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    found = registry.queries()["gt_stemmed_overlap"](spark, str(tmp_path)).select("q", "idx")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == brute([(k, n and n.split(" ")) for k, n in parts])
    assert "HashAggregate" not in plan
