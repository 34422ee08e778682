"""Files of the original form, cut into many blocks, against Python's decoder."""

import json
import os
import random

from cohortkit.session import scratch_path
from cohortkit.sources import tuple_files as TF


def awkward(rnd):
    parts = ['"], ["', "]", "[", '\\', '\\"', "\n", "é", "日", "</p>", '"', "a[0]", ', ["x"]', "plain text of a page ", "\\\\]"]
    return "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30)))


def test_any_block_size(spark):
    rnd = random.Random(1)
    path = scratch_path(spark, "test-tuples").replace("file:", "")
    os.makedirs(path)
    want = []
    for k, style in enumerate(({}, {"separators": (",", ":")}, {"indent": 2}, {"ensure_ascii": False}, {})):
        rows = [[awkward(rnd), rnd.choice(["informational", "navigational"]), awkward(rnd) if rnd.random() < 0.9 else None] for _ in range(60 if k < 4 else 0)]
        with open(f"{path}/synthetic_dataset_{k}.json", "w", encoding="utf-8") as f:
            json.dump(rows, f, **style)
        want += [(f"synthetic_dataset_{k}.json", i, *r) for i, r in enumerate(rows)]
    before = {c: spark.conf.get(c, None) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("150", "4000", "1000000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            got = TF.read_tuple_files(spark, path)
            if size == "4000":
                assert TF._pieces(spark, path).rdd.getNumPartitions() > 10
            assert sorted(map(tuple, got.collect()), key=lambda r: r[:2]) == want
    finally:
        for c, v in before.items():
            spark.conf.set(c, v) if v is not None else spark.conf.unset(c)


def test_written_files_are_json(spark):
    rows = [(f"<p>{k}]</p>\n\"", "commercial", None if k % 7 == 0 else f"é{k}") for k in range(50)]
    path = scratch_path(spark, "test-tuples").replace("file:", "")
    TF.write_tuple_files(spark.createDataFrame(rows, "html string, page_type string, summary string").repartition(3), path)
    found = []
    for name in sorted(os.listdir(path)):
        if name.endswith(".txt"):
            found += json.load(open(f"{path}/{name}", encoding="utf-8"))
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, rows))
    assert sorted((tuple(r)[2:] for r in TF.read_tuple_files(spark, path).collect()), key=repr) == sorted(rows, key=repr)


def test_odd_files(spark):
    path = scratch_path(spark, "test-tuples").replace("file:", "")
    os.makedirs(path)
    for k, text in enumerate(("", "[]", " [ [ \"a\" , \"b\" ] , [ null, \"]\", \"c\", \"more\" ] , [] ] ", "[[]]")):
        with open(f"{path}/f{k}.json", "w") as f:
            f.write(text)
    assert sorted(map(tuple, TF.read_tuple_files(spark, path).collect())) == [("f2.json", 0, "a", "b", None), ("f2.json", 1, None, "]", "c")]
