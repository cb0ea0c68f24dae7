"""Log files by byte range and as they grow."""

from __future__ import annotations

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from runhealth.sources.logfiles import log_file_records, log_lines, read_log_files
from runhealth.streaming import growing

HEAD = "2024-01-02 03:04:%02d | INFO | app.main | "


def log_text(rng: random.Random, n: int, above: bool, end: str) -> str:
    lines = ["above the first record", ""] if above else []
    for i in range(n):
        lines.append(HEAD % (i % 60) + f"record {i} " + "x" * rng.randint(0, 40))
        lines += rng.choice([[], [], ["  at step | one", "", "cause"], [f"line {j}" for j in range(rng.randint(1, 30))], ["\rcr"]])
    return "\n".join(lines) + end


@pytest.fixture
def folder(tmp_path):
    rng = random.Random(3)
    for name, text in {"agent.log": log_text(rng, 300, False, "\n"), "agent.log.1": log_text(rng, 200, True, ""),
                       "agent.log.2": "no record\nin here at all\n" * 40, "agent.log.3": HEAD % 1 + "one record\n" + "more\n" * 500,
                       "agent.log.4": log_text(rng, 1, False, "\n\n"), "other.log": "not read"}.items():
        (tmp_path / name).write_bytes(text.encode())
    return str(tmp_path)


def whole_records(folder):
    """Files read whole and cut before each record's first line."""
    out = []
    for name in sorted(os.listdir(folder)):
        if name.startswith("agent.log"):
            text = open(f"{folder}/{name}", newline="").read().removesuffix("\n")
            out += [(name, i, v) for i, v in enumerate(re.split(r"\n(?=\d{4}-\d\d-\d\d \d\d:\d\d:\d\d \| )", text))]
    return sorted(out)


@pytest.mark.parametrize("block", ["97", "1000", "128m"])
def test_blocks_of_any_size_give_the_records_of_whole_files(spark, folder, block):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        if block != "128m":
            blocks = log_lines(spark, folder, "agent.log").select("_path", "_block").distinct().groupBy("_path").count()
            assert blocks.agg(F.max("count")).first()[0] > 5
        got = log_file_records(spark, folder, "agent.log").collect()
        parsed = {(r["file"], r["record_no"]): r for r in read_log_files(spark, folder).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(map(tuple, got)) == whole_records(folder)
    assert len(parsed) == len(got) and parsed["agent.log.1", 0]["message"].startswith("above the first record")
    assert parsed["agent.log", 0]["logger"] == "app.main" and parsed["agent.log.3", 0]["message"].count("more") == 500


def test_an_empty_file_has_no_records(spark, tmp_path):
    (tmp_path / "agent.log").write_text("")
    assert log_file_records(spark, str(tmp_path), "agent.log").count() == 0


class Follower:
    def __init__(self, spark, home, chunk_bytes=40):
        self.spark, self.home = spark, home
        self.logs = f"{home}/logs"
        os.makedirs(self.logs)
        self.chunk_bytes = chunk_bytes

    def trigger(self):
        stream = growing.read_growing_logs(self.spark, self.logs, "agent.log", self.chunk_bytes)
        query = (stream.writeStream.format("parquet").option("path", f"{self.home}/out").option("checkpointLocation", f"{self.home}/checkpoint")
                 .trigger(availableNow=True).start())
        assert query.awaitTermination(120)
        rows = self.spark.read.schema(stream.schema).parquet(f"{self.home}/out").collect()
        return [r["value"] for r in sorted(rows, key=lambda r: int(r["value"].split()[0]) if r["value"].split()[0].isdigit() else -1)]

    def append(self, text, name="agent.log"):
        with open(f"{self.logs}/{name}", "ab") as out:
            out.write(text.encode())

    def rotate(self):
        for i in range(5, 0, -1):
            if os.path.exists(f"{self.logs}/agent.log.{i}"):
                os.rename(f"{self.logs}/agent.log.{i}", f"{self.logs}/agent.log.{i + 1}")
        os.rename(f"{self.logs}/agent.log", f"{self.logs}/agent.log.1")


def test_appended_and_rotated_lines_arrive_once(spark, tmp_path):
    f = Follower(spark, str(tmp_path))
    want = [f"{i} line é {'y' * (i % 50)}" for i in range(120)]
    f.append("\n".join(want[:20]) + "\n" + want[20][:3])  # the last line is not whole yet
    assert f.trigger() == want[:20]
    f.append(want[20][3:] + "\n" + want[21] + "\n")
    assert f.trigger() == want[:22]
    assert f.trigger() == want[:22]  # nothing new
    f.append("\n".join(want[22:60]) + "\n")
    f.rotate()  # lines appended and rotated away between two triggers, and a new file begun
    f.append("\n".join(want[60:80]) + "\n")
    assert f.trigger() == want[:80]
    f.append(want[80])  # rotated away without a line end: whole then
    f.rotate()
    f.append("\n".join(want[81:100]) + "\n")
    f.rotate()
    f.append("\n".join(want[100:]) + "\n")
    assert f.trigger() == want
    assert f.trigger() == want


def test_a_rename_between_plan_and_read_is_followed(tmp_path):
    logs = tmp_path / "agent.log"
    logs.write_bytes(b"first line\nsecond\nthird\n")
    reader = growing.GrowingLogReader({"path": str(tmp_path)})
    (chunk,) = reader.partitions({}, reader.latestOffset())
    logs.rename(tmp_path / "agent.log.1")
    (tmp_path / "agent.log").write_bytes(b"another file\n")
    assert [v for b in reader.read(chunk) for v in b.column("value").to_pylist()] == ["first line", "second", "third"]
    (tmp_path / "agent.log.1").unlink()
    with pytest.raises(FileNotFoundError, match="are gone"):
        list(reader.read(chunk))


def test_chunks_share_no_line_and_lose_none(tmp_path):
    lines = [b"x" * (i % 7) for i in range(200)]
    (tmp_path / "agent.log").write_bytes(b"head\n" + b"\n".join(lines) + b"\n")
    for size in (1, 2, 3, 10, 1000):
        reader = growing.GrowingLogReader({"path": str(tmp_path), "chunkbytes": str(size)})
        got = [v for c in reader.partitions({}, reader.latestOffset()) for b in reader.read(c) for v in b.column("value").to_pylist()]
        assert got == ["head", *[x.decode() for x in lines]]
