"""Following growing files: positions, half lines, rotation, cut files, restarts, ranges."""

import os

import pytest

from duskwatch.session import prepare
from duskwatch.sources import sensors, tail
from duskwatch.streaming import jobs


def write(path, *lines, mode="a", end="\n"):
    with open(path, mode, encoding="utf-8") as out:
        out.write("".join(line + "\n" for line in lines[:-1]) + (lines[-1] + end if lines else ""))


def new_lines(reader, before):
    after = reader.latestOffset()
    found = [line for p in reader.partitions(before, after) for b in reader.read(p) for line in b.column(2).to_pylist()]
    return found, after


@pytest.mark.parametrize("split", [3, 7, 1 << 20])
def test_growth_rotation_and_half_lines(tmp_path, split, monkeypatch):
    monkeypatch.setattr(tail, "CHUNK", 16)
    log = tmp_path / "eve.json"
    write(log, "old one", "old two")
    reader = tail.TailReader({"path": str(log), "splitbytes": str(split)})
    at = reader.initialOffset()
    assert new_lines(reader, at) == ([], at)
    write(log, "three", "", "a longer line of more than one chunk: fünf")
    write(log, "half", end="")
    found, at = new_lines(reader, at)
    assert found == ["three", "", "a longer line of more than one chunk: fünf"]
    write(log, " is whole now", "six")
    os.rename(log, tmp_path / "eve.json.1")
    write(log, "a new file", "eight")
    found, at = new_lines(reader, at)
    assert sorted(found) == ["a new file", "eight", "half is whole now", "six"]
    write(log, "cut and written anew", mode="w")
    assert new_lines(tail.TailReader({"path": str(log)}), at)[0] == ["cut and written anew"]
    write(log, "cut and written anew", mode="w")
    at = reader.latestOffset()
    write(log, "cut and written anew", "x", mode="w")
    os.truncate(log, len("cut and written anew\n"))
    assert new_lines(reader, at)[0] == []


def test_a_range_follows_a_renamed_file_and_says_when_it_is_gone(tmp_path):
    log = tmp_path / "eve.json"
    reader = tail.TailReader({"path": str(log), "from": "start"})
    assert reader.initialOffset() == reader.latestOffset() == {"files": {}}
    write(log, "one", "two")
    (part,) = reader.partitions(reader.initialOffset(), reader.latestOffset())
    os.rename(log, tmp_path / "eve.json.2")
    write(log, "other")
    assert [x for b in reader.read(part) for x in b.column(2).to_pylist()] == ["one", "two"]
    os.remove(tmp_path / "eve.json.2")
    with pytest.raises(FileNotFoundError):
        list(reader.read(part))


def test_stream_over_a_growing_file_with_a_restart(spark, tmp_path):
    prepare(spark)
    log, out, offsets = tmp_path / "eve.json", str(tmp_path / "out"), str(tmp_path / "offsets")
    event = '{"event_type": "alert", "timestamp": "2024-01-01T00:00:0%d.000000+0000", "alert": {"signature": "s%d", "severity": 1}}'
    write(log, event % (0, 0))

    def run():
        alerts = sensors.tail_network_events(spark, str(log)).select("alert.signature")
        jobs.start(jobs.append_parquet(alerts, out), offsets).awaitTermination()
        return sorted(r.signature for r in spark.read.schema("signature string").parquet(out).collect())

    assert run() == []
    write(log, event % (1, 1), '{"event_type": "flow"}', "not json", event % (2, 2))
    write(log, (event % (3, 3))[:40], end="")
    assert run() == ["s1", "s2"]
    write(log, (event % (3, 3))[40:])
    os.rename(log, tmp_path / "eve.json.1")
    write(log, event % (4, 4))
    assert run() == run() == ["s1", "s2", "s3", "s4"]
