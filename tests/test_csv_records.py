"""Multi-line CSV in splits against Spark's own multi-line reader."""

import random

import pytest

from outcome_engine.sources import csv_records as CR
from outcome_engine.sources.readers import CSV_OPTIONS, read_ventures_csv

HAND = [
    'a,b,c\n1,2,3\n4,5,6\n',
    'a,b,c\n1,"two\nlines",3\n4,"",6\n',
    'a,b,c\r\n1,"x\r\ny",3\r\n"q ""quoted"" q",5,6\r\n',
    'a,b,c\n"1\n\n\n2",",",""""\n\n7,8,9\n',
    'a,b,c\n1,5" disk,3\n4,"say ""hi""\nthere, you",6\n7,8,9',
    '"a","b","c"\n1,2\n1,2,3\n,,\n"only\none long,\nfield, of many\nlines",x,y\n',
    'a,b,c\n1,2,"never, closed\nbefore the end',
]


def spark_rows(spark, path):
    return sorted(map(str, spark.read.options(**CSV_OPTIONS).option("multiLine", True).csv(path).collect()))


@pytest.fixture()
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "16", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


@pytest.mark.parametrize("n", range(len(HAND)))
def test_equals_the_whole_file_reader(spark, tmp_path, small_splits, n):
    """Splits of sixteen bytes, so that quoted fields run over many of them."""
    (tmp_path / "x.csv").write_bytes(HAND[n].encode())
    got = sorted(map(str, read_ventures_csv(spark, str(tmp_path), multi_line=True).collect()))
    assert got == spark_rows(spark, str(tmp_path))


def test_random_files(spark, tmp_path, small_splits):
    rng = random.Random(6)
    cells = ["", "x", "two words", 'a "b" c', "l1\nl2", ",", '"', "\n", "é\n€", "1\r\n2"]
    for f in range(3):
        quote = lambda c: '"' + c.replace('"', '""') + '"' if any(x in c for x in ',"\n\r') or rng.random() < 0.3 else c
        rows = [",".join(quote(rng.choice(cells)) for _ in range(3)) for _ in range(9)]
        rows = [r if r else ",," for r in rows]
        (tmp_path / f"f{f}.csv").write_bytes(("a,b,c\n" + "\n".join(rows) + ("\n" if f else "")).encode())
    assert sorted(map(str, read_ventures_csv(spark, str(tmp_path), multi_line=True).collect())) == spark_rows(spark, str(tmp_path))


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "big.csv").write_text("a,b\n" + "".join(f'{i},"line one\nline two, {i}"\n' for i in range(20_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(64 << 10))
    try:
        assert CR._lines(spark, str(tmp_path)).rdd.getNumPartitions() >= 8
        df = read_ventures_csv(spark, str(tmp_path), multi_line=True)
        assert df.columns == ["a", "b"] and df.count() == 20_000
        assert df.selectExpr("count_if(b = concat('line one\\nline two, ', a))").first()[0] == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_line_states():
    assert [CR.ends_inside(x, False) for x in ('a,b', 'a,"b', '"a","b"', '"a""', 'a"b', 'x,"a,b",c"', '"')] == [False, True, False, True, False, False, True]
    assert [CR.ends_inside(x, True) for x in ('a,b', 'a",b', 'a","b', 'a""b', '""', '"', '","x')] == [True, False, True, True, True, False, True]


def test_empty_input(spark, tmp_path):
    (tmp_path / "e.csv").write_text("")
    with pytest.raises(ValueError):
        read_ventures_csv(spark, str(tmp_path), multi_line=True)
    (tmp_path / "h.csv").write_text("a,b\n")
    assert read_ventures_csv(spark, str(tmp_path), multi_line=True).collect() == []
