"""Files whose records cross ranges: delimited text with breaks in quotes, JSON arrays, one array of many files."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from tunekit.sources import datasets as D
from tunekit.sources import delimited, json_arrays, one_array
from tunekit.sources import writers as W


@pytest.fixture
def small_ranges(spark):
    """Files are cut into ranges of so many bytes."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(k) for k in keys]

    def use(size):
        spark.conf.set(keys[0], str(size))
        spark.conf.set(keys[1], "1")

    yield use
    for k, v in zip(keys, old):
        spark.conf.set(k, v)


def odd_text(rng, bits, most):
    return "".join(rng.choice(bits) for _ in range(rng.randrange(most)))


def test_rows_are_cut_as_the_csv_module_reads_them():
    rng, step = random.Random(4), delimited.line_step(",")
    bits = ['a', '"', '""', ',', ' ', '\n', 'b', '\r\n', ', "', '"\n', '",']
    tried = 0
    for _ in range(20_000):
        text = odd_text(rng, bits, 25)
        try:
            want = [r for r in csv.reader(io.StringIO(text, newline=""), skipinitialspace=True) if r]
        except csv.Error:
            continue
        lines = text.encode().split(b"\n")
        found = list(delimited.records(iter(lines[:-1] if lines[-1] == b"" else lines), step, False, False))
        got = [c for c in delimited.cells_of([r.decode() for _, r in found], ",") if c]
        if step(found[-1][1].replace(b"\n", b" "), False)[0] if found else False:
            continue  # a quote that is never closed: the last line break isn't part of the text
        tried += 1
        assert got == want, text
    assert tried > 5000


@pytest.mark.parametrize("size", [1 << 30, 20_000, 4_000])
def test_csv_in_ranges(spark, tmp_path, small_ranges, size):
    rng = random.Random(size)
    bits = ["word ", '"', ",", "\n", "\r\n", "é", "\n\n", '"x"', "\t"]
    rows = [(str(i), odd_text(rng, bits, 40), rng.choice(["", "x", 'y "z" 5"'])) for i in range(1200)]
    rows[600] = ("600", "long\n" * 2000, "x")  # one row over several ranges
    with open(tmp_path / "a.csv", "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(["id", "te\nxt", "more"])
        out.writerows(rows)
    small_ranges(size)
    got = D.read_csv(spark, str(tmp_path / "a.csv"))
    assert got.columns == ["id", "te\nxt", "more"]
    assert spark.read.text(str(tmp_path / "a.csv")).rdd.getNumPartitions() > (0 if size > 1 << 20 else 3)
    want = sorted((i, t if t.strip() else None, m or None) for i, t, m in rows)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_many_files_headers_and_surplus_in_ranges(spark, tmp_path, small_ranges):
    rng, want = random.Random(7), []
    for k in range(5):
        names = ["a", "b"] if k % 2 else ["b", "c"]
        lines = [",".join(names)] if k != 3 else ["﻿".strip("﻿") + ",".join(names)]
        for i in range(200):
            cell = f"{k}-{i}" + "\n" * rng.randrange(3)
            lines.append(f'"{cell}",{i}' + (',"s,1",t' if i == 9 else ""))
            row = dict(zip(names, (cell, str(i))))
            want.append((row.get("a"), row.get("b"), row.get("c"), '["s,1","t"]' if i == 9 else None))
        (tmp_path / f"{k}.csv").write_text("\n".join(lines) + ("\n" if k else ""))
    (tmp_path / "5.csv").write_text("")
    (tmp_path / "6.csv").write_text("\n\n")
    small_ranges(1_000)
    got = D.read_csv(spark, str(tmp_path), extra="more").select("a", "b", "c", "more")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    with pytest.raises(Exception, match="more cells"):
        D.read_csv(spark, str(tmp_path)).collect()
    with pytest.raises(ValueError, match="different headers"):
        D.read_csv(spark, str(tmp_path), one_header=True)
    assert D.read_csv(spark, str(tmp_path / "5.csv")).columns == []


def test_partitions_smaller_than_the_cost_of_a_file(spark, tmp_path, small_ranges):
    (tmp_path / "a.csv").write_text("a,b\n" + "".join(f'{i},"x\ny"\n' for i in range(500)))
    (tmp_path / "a.json").write_text(json.dumps([{"a": i} for i in range(500)]))
    small_ranges(1000)
    spark.conf.set("spark.sql.files.openCostInBytes", str(4 << 20))
    assert D.read_csv(spark, str(tmp_path / "a.csv")).where("b = 'x\ny'").count() == 500
    assert D.read_json(spark, str(tmp_path / "a.json"), "a long").distinct().count() == 500


def test_odd_csv(spark, tmp_path):
    f = tmp_path / "x.csv"
    f.write_bytes(b'\n\r\nid,A,a,\r\n1,"p\x00q"r,5" disk,\xff\r\n2,  "x""\n ",,\r\n\r\n3,"open,\n4')
    got = D.read_csv(spark, str(f))
    assert got.columns == ["id", "A", "a2", "_c3"]
    assert sorted(tuple(r) for r in got.collect()) == [("1", "pqr", '5" disk', "�"), ("2", 'x"\n ', None, None), ("3", "open,\n4", None, None)]


def test_rows_behind_their_lines_are_refused(spark, tmp_path):
    f = tmp_path / "x.csv"
    f.write_text('id,t\n1,"a\nb"\n')
    with pytest.raises(D.FormatError, match="multiline=True"):
        D.read_csv(spark, str(f), multiline=False)
    assert D.read_csv(spark, str(f)).first()["t"] == "a\nb"
    f.write_text('id,t\n1,5" disk\n2,"x"\n')
    assert sorted(r["t"] for r in D.read_csv(spark, str(f), multiline=False).collect()) == ['5" disk', "x"]


def some_items(n):
    rng = random.Random(n)
    bits = ["}", '"', "\\", "{", "[", "]", "x", ",", "é", "\n"]
    return [{"id": i, "t": odd_text(rng, bits, 50), "n": [{"q": "}"}] * rng.randrange(3)} for i in range(n)]


@pytest.mark.parametrize("size", [1 << 30, 20_000, 3_000])
@pytest.mark.parametrize("form", [{}, {"indent": 2, "ensure_ascii": False}])
def test_json_array_in_ranges(spark, tmp_path, small_ranges, size, form):
    items = some_items(700)
    items[300]["t"] = "}" * 9000  # one item over several ranges
    (tmp_path / "x.json").write_text("\n " + json.dumps(items, **form) + "\n\n")
    small_ranges(size)
    got = D.read_json(spark, str(tmp_path / "x.json"))
    assert got.columns == ["id", "n", "t"]
    assert sorted((r.id, r.t, [x.q for x in r.n]) for r in got.collect()) == [(x["id"], x["t"], [y["q"] for y in x["n"]]) for x in items]
    assert D.read_json(spark, str(tmp_path / "x.json"), "id long", strict=False).count() == 700


GOOD = ["", " \n", "[]", "[ ]", '[{"a":"1"}]', '[{"a":"}]}{"},\n{"a":"\\"}"} ]\n']
BAD = [
    '[{"a":1}}, {"b":2}]',
    '[{"a":1},]',
    '[{"a":1} {"a":2}]',
    '{"a":1}',
    '[{"a":1}] x',
    '[,{"a":1}]',
    '[{"a":1}, 2] , [3, {"b":2}]',
    '[{"a":1}',
    '[{"a":1}],{"a":2}]',
    "7",
    '[{"a":"1}]',
    "]",
]


@pytest.mark.parametrize("size", [1 << 30, 12])
def test_json_array_shapes(spark, tmp_path, small_ranges, size):
    for i, text in enumerate(GOOD + BAD):
        (tmp_path / f"{i:02d}.json").write_text(text)
    small_ranges(size)
    runs = json_arrays.item_runs(spark, str(tmp_path)).collect()
    items = {}
    for r in runs:
        items.setdefault(r.file[-7:-5], []).append(r)
    for i, text in enumerate(GOOD):
        own = items.get(f"{i:02d}", [])
        assert all(r.error is None for r in own)
        assert sorted(json.dumps(x) for r in own for x in json.loads(f"[{r['items']}]")) == sorted(json.dumps(x) for x in (json.loads(text) if text.strip() else []))
    for i in range(len(GOOD), len(GOOD) + len(BAD)):
        if size < 1000:  # one strict and one lax read of each are enough
            return
        with pytest.raises(Exception, match=r"in file:|no JSON"):
            D.read_json(spark, str(tmp_path / f"{i:02d}.json"), "a string").collect()
    lax = D.read_json(spark, str(tmp_path), "a string", strict=False)
    assert sorted(r.a for r in lax.collect()) == sorted(["1", "}]}{", '"}'])


def test_items_that_are_no_objects(spark, tmp_path):
    f = tmp_path / "x.json"
    f.write_text('[1, {"a":2}, "x", [3, {"b":1}], {"a":4}, null, 5]')
    assert sorted(r.a for r in D.read_json(spark, str(f), "a long", strict=False).collect()) == [2, 4]
    with pytest.raises(Exception):
        D.read_json(spark, str(f), "a long").collect()


def joined_text(path):
    return b"".join(p.read_bytes() for p in sorted(path.glob("part-*"))).decode()


def test_one_array(spark, tmp_path):
    df = spark.range(500).select("id", F.concat(F.lit('a"}{\n'), "id").alias("t"), F.lit(None).cast("string").alias("none"))
    path = tmp_path / "a"
    W.write_dataset(df.repartition(7), str(path), "json", one_array=True)
    found = json.loads(joined_text(path))
    assert len(list(path.glob("part-*"))) > 3 and sorted(x["id"] for x in found) == list(range(500)) and "none" in found[0]
    back = D.read_json(spark, str(path), joined_files=True)
    assert sorted(map(tuple, back.select("id", "t", "none").collect())) == [tuple(r) for r in df.collect()]
    with pytest.raises(FileExistsError):
        one_array.write_json_array(df, str(path))
    with pytest.raises(ValueError, match="written whole"):
        one_array.write_json_array(df, str(path), "append")
    one_array.write_json_array(df.where("id > 490").coalesce(8), f"file://{path}", "overwrite")  # the first partitions are empty
    assert sorted(x["id"] for x in json.loads(joined_text(path))) == list(range(491, 500))
    one_array.write_json_array(df.orderBy("id"), str(tmp_path / "b"), nulls=False)
    assert [x["id"] for x in json.loads(joined_text(tmp_path / "b"))] == list(range(500)) and "none" not in joined_text(tmp_path / "b")
    one_array.write_json_array(df.limit(0), str(tmp_path / "c"))
    assert joined_text(tmp_path / "c") == "[]" and D.read_json(spark, str(tmp_path / "c"), "id long", joined_files=True).count() == 0


def test_a_failed_array_leaves_nothing(spark, tmp_path):
    bad = spark.range(100).select(F.when(F.col("id") == 77, F.raise_error(F.lit("stop"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="stop"):
        one_array.write_json_array(bad, str(tmp_path / "a"))
    assert not (tmp_path / "a").exists()
    one_array.write_json_array(spark.range(3), str(tmp_path / "a"))
    with pytest.raises(Exception, match="stop"):
        one_array.write_json_array(bad, str(tmp_path / "a"), "overwrite")
    assert len(json.loads(joined_text(tmp_path / "a"))) == 3
