"""Published tables, the cache, a stream's log across a kill, and the table function."""

import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestone.operators import udtf
from lodestone.sources.published import Cache, Published, freeze
from lodestone.streaming import resume


def digests(root, folders):
    return {f"{f}/{p.name}": hashlib.sha256(p.read_bytes()).hexdigest() for f in folders for p in sorted((Path(root) / f).glob("*.parquet"))}


def test_parts_that_are_not_written_anew_keep_their_bytes(spark, tmp_path):
    root = str(tmp_path / "frozen")
    table, rows = Published(spark, root), lambda name, n: spark.createDataFrame([(name, i) for i in range(n)], "retriever string, id int")
    assert table.read() is None and table.parts() == {}
    freeze(table, rows("a", 5).unionByName(rows("b", 3)))
    before = digests(root, table.parts()["a"])
    freeze(table, rows("b", 7))
    assert digests(root, table.parts()["a"]) == before and before
    assert sorted(table.read().groupBy("retriever").count().collect()) == [("a", 5), ("b", 7)]
    assert table.number() == 2 and table.read("a").count() == 5


def test_an_interrupted_write_shows_nothing(spark, tmp_path, monkeypatch):
    table = Published(spark, str(tmp_path / "t"))
    table.replace({"x": spark.range(3)})
    with monkeypatch.context() as m:
        m.setattr(Published, "_publish", lambda *a: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            table.replace({"x": spark.range(9)})
    assert table.read("x").count() == 3 and table.number() == 1


def test_only_one_of_two_writers_takes_a_number(spark, tmp_path):
    table = Published(spark, str(tmp_path / "t"))
    table.replace({"x": spark.range(3)})
    with pytest.raises(Exception, match="exist"):
        table._publish({"x": ["elsewhere"]}, 0)  # another writer has taken 1 meanwhile
    assert table.parts()["x"] != ["elsewhere"]


def test_cache_makes_each_value_once(spark, tmp_path):
    cache, made = Cache(spark, str(tmp_path / "c")), []

    def make(rows):
        made.append(sorted(r.key for r in rows.collect()))
        return rows.select("key", (F.col("x") * 2).alias("value"))

    keys = lambda *ks: spark.createDataFrame([(k, float(ord(k))) for k in ks], "key string, x double")
    assert sorted(map(tuple, cache.get(keys("a", "b", "a"), make).collect())) == [("a", 194.0), ("b", 196.0)]
    assert sorted(map(tuple, cache.get(keys("b", "c"), make).collect())) == [("b", 196.0), ("c", 198.0)]
    assert cache.get(keys("a"), make).count() == 1 and made == [["a", "b"], ["c"]]
    assert cache.missing(keys("c", "d")).collect() == [("d",)]


def test_stream_killed_before_commit_writes_nothing_twice(spark, tmp_path):
    source, log, checkpoint = (str(tmp_path / x) for x in ("in", "log", "cp"))
    Path(source).mkdir()
    lines = lambda a, b: "".join(f'{{"call_id":"{k}"}}\n' for k in range(a, b))
    (Path(source) / "1.json").write_text(lines(0, 5))
    stream = lambda: spark.readStream.schema("call_id string").json(source)

    def kill(number):
        raise RuntimeError("killed after the write")

    q = resume.append_once(stream(), log, checkpoint, kill)
    with pytest.raises(Exception, match="killed"):
        q.awaitTermination(60)
        raise q.exception()
    assert resume.logged(spark, log, "call_id string").count() == 5  # written, not committed
    (Path(source) / "2.json").write_text(lines(5, 9))
    for _ in range(2):
        resume.append_once(stream(), log, checkpoint).awaitTermination(60)
    assert sorted(r.call_id for r in resume.logged(spark, log, "call_id string").select("call_id").collect()) == [str(k) for k in range(9)]


def test_table_function_takes_any_columns(spark):
    udtf.register(spark)
    spark.createDataFrame([(1, 3, 0.5, "x"), (1, 2, 0.5, "y"), (1, 1, 0.9, None), (2, 9, 0.1, "z")], "q int, id int, score double, note string").createOrReplaceTempView("ranking")
    got = sorted(map(tuple, spark.sql("SELECT q, id, note, rank FROM retrieve(TABLE(ranking), 2)").collect()))
    assert got == [(1, 1, None, 1), (1, 2, "y", 2), (2, 9, "z", 1)]
    with pytest.raises(Exception, match="lacks"):
        spark.sql("SELECT * FROM retrieve(TABLE(SELECT q FROM ranking), 2)").collect()
