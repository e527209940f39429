"""JSON arrays that many tasks read, against Python's reader."""

from __future__ import annotations

import json
import random

import pytest

from ledgerlens.sources import json_arrays as J
from ledgerlens.sources import readers as R


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], "700")
    spark.conf.set(names[1], "1")
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def _rows(n: int):
    rng = random.Random(3)
    marks = ['"', "\\", "{", "}", "[", "]", ",", "x", " ", "é", "\n", '\\"', "}{"]
    return [{"id": i, "note": "".join(rng.choices(marks, k=rng.randrange(40))), "in": {"deep": [{"k": j} for j in range(i % 3)]},
             "long": "}" * (900 if i % 50 == 0 else 0)} for i in range(n)]


@pytest.mark.parametrize("indent", [None, 2])
def test_elements_over_many_splits(spark, tmp_path, small_splits, indent):
    rows = _rows(300)
    for name, part in (("a.json", rows[:220]), ("b.json", rows[220:]), ("c.json", [])):
        (tmp_path / name).write_text(json.dumps(part, indent=indent, ensure_ascii=False), encoding="utf-8")
    assert J._pieces(spark, str(tmp_path)).select("file", "split").distinct().count() > 20
    got = sorted((json.loads(r.value) for r in J.array_elements(spark, str(tmp_path)).collect()), key=lambda r: r["id"])
    assert got == rows
    df = R.read_json(spark, str(tmp_path))
    assert sorted(df.columns) == ["id", "in.deep", "long", "note"]
    assert {r.id: r.note for r in df.collect()} == {r["id"]: r["note"] for r in rows}


@pytest.mark.parametrize("text", ['[1, {"a": 2}]', '[{"a": 1}, 2]', '[[{"a": 1}]]', '[{"a": 1}, {"a": ', '[{"a": 1}{"a": 2}]', '[{"a": 1},]', '[{"a": 1}',
                                  '[{"a": 1}]]'])
def test_other_arrays_are_not_split(spark, tmp_path, text):
    path = tmp_path / "x.json"
    path.write_text(text)
    assert J.first_character(spark, str(path)) == "[" and J.array_lines(spark, str(path)) is None


def test_written_arrays_come_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "a}"), (2, None), (3, '"[')], "k int, t string").repartition(4)
    J.write_json_arrays(df, str(tmp_path / "out"))
    parts = [json.loads(p.read_text()) for p in (tmp_path / "out").glob("part-*")]
    assert sorted((r["k"], r.get("t")) for p in parts for r in p) == [(1, "a}"), (2, None), (3, '"[')]
    assert sorted(map(tuple, R.read_json(spark, str(tmp_path / "out")).select("k", "t").collect())) == [(1, "a}"), (2, None), (3, '"[')]
    with pytest.raises(R.EmptyDatasetError):
        R.read_json(spark, J.write_json_arrays(df.limit(0), str(tmp_path / "none")))
