import os
import shutil

import pytest
from pyspark.sql import functions as F

from pactframe.plans.registry import PLANS, Source
from pactframe.session import work_dir
from pactframe.sources import follow
from pactframe.streaming.sink import KeyedTable, run_to_end

SMALL = "/root/testdata/sf0.001"


def answers(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("name", ["t1_span_stream", "t4_host_samples", "t9_progress", "t5_live_windows", "t6_tumbling", "t10_growing_log"])
def test_file_folder_and_empty_table_stream_alike(spark, name, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/many/events.parquet")
    events.limit(0).write.parquet(f"{tmp_path}/none/events.parquet")
    want = answers(PLANS[name](Source(spark, SMALL)))
    assert want and answers(PLANS[name](Source(spark, f"{tmp_path}/many"))) == want
    assert not answers(PLANS[name](Source(spark, f"{tmp_path}/none")))


def followed(spark, folder, table):
    run_to_end(follow.stream_growing(spark, str(folder)), table)
    return sorted((r.file, r.value) for r in table.batches().collect())


def test_growing_log_reads_every_line_once(spark, tmp_path):
    table = KeyedTable(spark, work_dir(spark, "follow"), ["value"], [])
    log = tmp_path / "a.log"
    assert followed(spark, tmp_path, table) == []
    log.write_bytes(b"one\ntwo\r\n\nhalf")
    (tmp_path / "other.txt").write_text("not a log\n")
    want = [("a.log", "one"), ("a.log", "two")]
    assert followed(spark, tmp_path, table) == want
    with log.open("ab") as out:
        out.write("way ü\nthree\n".encode())
    (tmp_path / "b.log").write_text("late file\n")
    want += [("a.log", "halfway ü"), ("a.log", "three"), ("b.log", "late file")]
    assert followed(spark, tmp_path, table) == sorted(want)
    assert followed(spark, tmp_path, table) == sorted(want)  # nothing new
    log.write_text("after\n")  # truncated
    assert followed(spark, tmp_path, table) == sorted(want := [*want, ("a.log", "after")])
    log.write_text("another file under the name, longer than before\n")  # replaced
    assert followed(spark, tmp_path, table) == sorted(want := [*want, ("a.log", "another file under the name, longer than before")])
    os.remove(log)
    assert followed(spark, tmp_path, table) == sorted(want)


@pytest.mark.parametrize("part,chunk", [(1, 1), (3, 2), (7, 64), (64, 5), (1000, 1000)])
def test_ranges_share_out_the_lines(tmp_path, monkeypatch, part, chunk):
    monkeypatch.setattr(follow, "PART", part)
    monkeypatch.setattr(follow, "CHUNK", chunk)
    lines = [f"{'x' * (i * 7 % 13)}{i}" for i in range(60)]
    (tmp_path / "a.log").write_text("\n".join(lines) + "\nunfinished")
    reader = follow.GrowingLogReader(str(tmp_path), ".log")
    end = reader.latestOffset()
    parts = reader.partitions({}, end)
    assert [v for p in parts for b in reader.read(p) for v in b.column(1).to_pylist()] == lines
    assert not reader.partitions(end, end)
    shutil.rmtree(tmp_path)
    assert reader.latestOffset() == {}


def test_compacted_batches_read_the_same(spark):
    table = KeyedTable(spark, work_dir(spark, "sums"), ["k"], [])
    for n in range(3):
        table.write_batch(spark.range(10).select((F.col("id") % 4).alias("k"), F.lit(n + 1).alias("n")), n)
    want = answers(table.read_sums())
    merge = lambda rows: rows.groupBy("k").agg(F.sum("n").cast("int").alias("n"))
    table.compact_batches(merge)
    assert answers(table.read_sums()) == want and table.batches().count() == 4
    table.write_batch(spark.createDataFrame([(9, 5)], "k long, n int"), 3)
    assert answers(table.read_sums()) == sorted([*want, (9, 5)])
