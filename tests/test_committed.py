"""Appends of several writers to one table."""

import pytest
from pyspark.sql import functions as F

from duskwatch.session import name_once
from duskwatch.sources import committed


def rows_of(spark, pairs):
    return spark.createDataFrame(pairs, "k INT, v STRING")


def held(spark, path):
    return sorted(tuple(r) for r in committed.read_committed(spark, path).collect())


def test_each_key_once(spark, tmp_path):
    path = str(tmp_path / "t")
    assert committed.read_committed(spark, path) is None
    first = committed.append_committed(rows_of(spark, [(1, "b"), (1, "a"), (2, "c")]), path, ["k"])
    assert sorted(map(tuple, first.collect())) == [(1, "a"), (2, "c")]
    again = committed.append_committed(rows_of(spark, [(1, "z"), (2, "c"), (3, "d")]), path, ["k"])
    assert [tuple(r) for r in again.collect()] == [(3, "d")]
    assert committed.append_committed(rows_of(spark, [(3, "x")]), path, ["k"]).count() == 0
    assert committed.append_committed(rows_of(spark, []), path, ["k"]).count() == 0
    assert held(spark, path) == [(1, "a"), (2, "c"), (3, "d")]
    assert len(list((tmp_path / "t" / "commits").glob("*.commit"))) == 2


def test_a_writer_that_dies_midway(spark, tmp_path):
    path = str(tmp_path / "t")
    committed.append_committed(rows_of(spark, [(1, "a")]), path, ["k"])

    def die():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        committed.append_committed(rows_of(spark, [(1, "x"), (2, "b")]), path, ["k"], before_commit=die)
    assert held(spark, path) == [(1, "a")]
    committed.append_committed(rows_of(spark, [(1, "x"), (2, "b")]), path, ["k"])
    assert held(spark, path) == [(1, "a"), (2, "b")]


@pytest.mark.parametrize("start", [[], [(0, "s")]])
def test_two_writers_at_once(spark, tmp_path, start):
    path = str(tmp_path / "t")
    if start:
        committed.append_committed(rows_of(spark, start), path, ["k"])
    attempts = []

    def other():
        attempts.append(1)
        if len(attempts) == 1:  # while the first writer has written, but not committed
            committed.append_committed(rows_of(spark, [(1, "other"), (2, "other")]), path, ["k"])

    added = committed.append_committed(rows_of(spark, [(0, "s"), (1, "mine"), (3, "mine")]).filter(F.lit(True)), path, ["k"], before_commit=other)
    assert len(attempts) == 2
    assert sorted(map(tuple, added.collect())) == ([] if start else [(0, "s")]) + [(3, "mine")]
    assert held(spark, path) == [(0, "s"), (1, "other"), (2, "other"), (3, "mine")]


def test_a_name_is_taken_once(spark, tmp_path):
    path = str(tmp_path / "n" / "0.commit")
    assert name_once(spark, path, "a") and not name_once(spark, path, "b")
    assert (tmp_path / "n" / "0.commit").read_text() == "a"
    assert [p.name for p in (tmp_path / "n").iterdir() if not p.name.startswith(".")] == ["0.commit"]
