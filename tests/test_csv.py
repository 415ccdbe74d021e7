"""CSV files of several splits with quoted line breaks, against a reader of whole files."""

import csv
import random

import pytest
from rosterlane.sources import entities


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "40"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def write(path, rows, end):
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, lineterminator=end)
        out.writerow(["name", "city", "phone", "zip"])
        out.writerows(rows)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_of_many_splits(spark, tmp_path, small_splits, end):
    rng = random.Random(5)
    field = lambda: rng.choice(["plain", "two\nlines", 'a "quoted" word', '"\n"', "a, b", "\n\n\n", "long " * 60, 'many\n"lines"\n' * 40, ""])
    every = []
    for k in range(3):
        rows = [(f"n{k}-{i}", field(), field(), str(i)) for i in range(150)]
        write(tmp_path / f"{k}.csv", rows, end)
        every += rows
    got = entities.read_entities_csv(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    blank = lambda x: x.strip() or None
    assert sorted((r.name, r.city or "", r.phone or "", r.zip) for r in got.collect()) == sorted((n, blank(c) or "", blank(p) or "", z) for n, c, p, z in every)
    assert got.where("corrupt is not null").count() == 0


def test_a_file_with_a_stray_quote_is_cut_at_line_ends(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text("name,city\n" + "".join(f"n{i},c{i}\n" for i in range(200)) + 'odd,5" pipe\nlast,x\n')
    (tmp_path / "b.csv").write_text('name,city\nb,"x\ny"\n')
    got = {r.name: r.city for r in entities.read_entities_csv(spark, str(tmp_path)).collect()}
    assert len(got) == 203 and got["b"] == "x\ny" and got["last"] == "x" and got["odd"].startswith("5")
