"""Quoted CSV read by many tasks, against the reader that takes whole files."""

import csv
import random

import pytest

from replyloom.sources.quoted_csv import read_quoted_csv, read_records
from replyloom.sources.tables import read_table

SCHEMA = "id bigint, t string, k int"
PARTS = ["a", '"', "\n", "bc,", '""', "é", "\r\n", " ", "字", "x" * 9, "\n\n", ","]


@pytest.fixture()
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "50")
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def write(path, records, end, header=("id", "t", "k")):
    with open(path, "w", newline="", encoding="utf-8") as out:
        writer = csv.writer(out, lineterminator=end)
        if header:
            writer.writerow(header)
        writer.writerows(records)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_equals_the_whole_file_reader(spark, small_splits, tmp_path, end):
    rnd = random.Random(7)
    written = []
    for number in range(3):
        records = [
            (number * 1000 + i, "".join(rnd.choices(PARTS, k=300 if i % 25 == 0 else rnd.choice([0, 1, 5, 30]))),
             rnd.choice(["", "z", "1"]))
            for i in range(80 * (number != 2))
        ]
        write(tmp_path / f"{number}.csv", records, end)
        written += records
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    found = rows(read_quoted_csv(spark, str(tmp_path), SCHEMA))
    assert found == sorted(
        ((i, t or None, int(k) if k == "1" else None) for i, t, k in written), key=repr)
    if end == "\n":
        assert found == rows(read_table(spark, str(tmp_path), SCHEMA))


def test_one_quoted_text_over_many_splits(spark, small_splits, tmp_path):
    text = 'line, with "quotes"\n' * 200
    write(tmp_path / "a.csv", [(1, text, 2), (2, "plain", 3)], "\n", header=("i\nd", "t", "k"))
    assert rows(read_quoted_csv(spark, str(tmp_path), SCHEMA)) == [(1, text, 2), (2, "plain", 3)]


def test_odd_files(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "head.csv").write_text("\n\nid,t,k\n")
    (tmp_path / "short.csv").write_text('id,t,k\n\n1\nx,"",3,4\n2,"never closed\n3,a,4')
    assert rows(read_quoted_csv(spark, str(tmp_path), SCHEMA)) == rows(read_table(spark, str(tmp_path), SCHEMA))
    assert read_records(spark, str(tmp_path)).where("file like '%head.csv' and value != ''").count() == 1
    (tmp_path / "bare").mkdir()
    write(tmp_path / "bare" / "b.csv", [(1, "a\n", 2)] * 3, "\n", header=None)
    assert rows(read_quoted_csv(spark, str(tmp_path / "bare"), SCHEMA, header=False)) == [(1, "a\n", 2)] * 3


def test_records_inside_a_split_are_not_shuffled(spark, small_splits, tmp_path):
    """Records over several lines, most of them in one split: only pieces at the ends of splits reach the exchange."""
    write(tmp_path / "a.csv", [(i, "a\nb\nc", 1) for i in range(400)], "\n")
    frame = read_records(spark, str(tmp_path), header=True)
    written = frame.where("file is not null")
    assert written.count() == 400
    shuffled = written._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in shuffled and "Join" not in shuffled
    splits = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
    lines = read_quoted_lines(spark, tmp_path)
    assert 0 < lines <= 2 * splits < 400


def read_quoted_lines(spark, path):
    """Rows that the grouping of records takes in."""
    from replyloom.sources import quoted_csv as qc

    states = {
        (r["file"], r["start"]): (r["within"], *(r["owner"] or (r["start"], 0)), bool((r["within"] + r["odd"]) % 2))
        for r in qc.split_states(spark, str(path)).collect()
    }
    return qc._lines(spark, str(path)).mapInArrow(lambda batches: qc._pieces(batches, states, {}, False), qc.PIECE).count()
