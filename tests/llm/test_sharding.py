from collections import Counter

import duckdb
import pytest

from peakframe.llm import sharding as S

from ..conftest import SMALL
from .cases import awkward, empty


def test_table_is_fair_and_stable():
    names = [f"n{i}" for i in range(10)]
    table = S.fill_table(names, 1009)
    counts = Counter(table)
    assert set(counts) == set(range(10)) and max(counts.values()) - min(counts.values()) <= 1
    fewer = S.fill_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 9)
    assert moved < 0.25 * 1009
    # by taking turns, one slot at a time
    orders = [[(s + k * d) % 1009 for k in range(1009)] for s, d in (S.preference(n, 1009) for n in names)]
    want, free = [-1] * 1009, 1009
    while free:
        for i, o in enumerate(orders):
            if free:
                want[next(x for x in o if want[x] < 0)] = i
                free -= 1
    assert table == want
    for bad in ((["a"], 10), ([], 7), ([str(i) for i in range(9)], 7)):
        with pytest.raises(ValueError):
            S.fill_table(*bad)


def test_placement(spark, tmp_path):
    docs = awkward(spark)
    out = S.shard(docs, "doc_id")
    assert out.count() == docs.count() and set(out.columns) == {*docs.columns, "slot", "shard"}
    assert all(r.slot == 0 for r in out.where("doc_id is null").collect())
    assert S.shard(empty(spark), "doc_id").count() == 0
    S.write_shards(docs.select("doc_id", "text"), "doc_id", str(tmp_path / "s"), files=2)
    assert spark.read.parquet(str(tmp_path / "s")).count() == docs.count()


def test_equals_oracle(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    got = S.shard(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id"), "doc_id")
    assert sorted(map(tuple, got.select("doc_id", "slot", "shard").collect())) == sorted(c.execute(S.oracle()).fetchall())
