"""Records of large JSON files cut by byte ranges, against the json module."""

import json
import random

import pytest
from pyspark.sql import types as T

from tidemark.sources import readers
from tidemark.sources.json_array import read_records

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("deep", T.StructType([T.StructField("x", T.StringType())]))])


@pytest.fixture
def ranges(spark):
    """Files are cut into ranges of a few hundred bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(n) for n in names]
    yield lambda n: [spark.conf.set(name, n) for name in names]
    for name, v in zip(names, old):
        spark.conf.set(name, v)


def awkward(rng, n):
    """Texts full of what could be taken for the end of a record."""
    bits = ['"', "\\", "{", "}", "},{", "[", "]", "\n", "é", "漢", '\\"', "a", " ", '"}', "\\\\"]
    return [{"id": i, "text": "".join(rng.choice(bits) for _ in range(rng.choice([0, 3, 30, 700 if i % 17 == 0 else 40]))), "deep": {"x": rng.choice(["", "}", "{\"", "y" * 50])}} for i in range(n)]


def rows_of(df):
    return sorted((r.id, r.text, r.deep.x) for r in df.collect())


@pytest.mark.parametrize("size", [64, 331, 1 << 20])
@pytest.mark.parametrize("indent", [None, 2])
def test_records_of_an_array(spark, tmp_path, ranges, size, indent):
    rng = random.Random(size)
    want = []
    for k in range(2):
        items = awkward(rng, 60)
        (tmp_path / f"f{k}.json").write_text(json.dumps(items, indent=indent, ensure_ascii=bool(k)))
        want += items
    ranges(size)
    got = read_records(spark, [str(tmp_path)], SCHEMA)
    if size < 1000:
        assert got.rdd.getNumPartitions() > 2
    assert rows_of(got.where("_corrupt_record is null")) == sorted((r["id"], r["text"], r["deep"]["x"]) for r in want)
    assert got.where("_corrupt_record is not null").count() == 0


def test_objects_inside_an_envelope(spark, tmp_path, ranges):
    items = awkward(random.Random(5), 40)
    (tmp_path / "f.json").write_text(json.dumps({"kind": "}{", "data": {"after": "x}", "children": items, "n": {"a": 1}}}))
    ranges(200)
    got = rows_of(read_records(spark, [str(tmp_path)], SCHEMA, level=2).where("id is not null"))
    assert got == sorted((r["id"], r["text"], r["deep"]["x"]) for r in items)


def test_broken_objects_stay_apart(spark, tmp_path, ranges):
    (tmp_path / "f.json").write_text('[{"id": 1, "text": "a"}, {"id": tru, "text": "b"}, {"id": 3, "text": "c"}]')
    (tmp_path / "empty.json").write_text("[]")
    ranges(16)
    rows = read_records(spark, [str(tmp_path)], SCHEMA).collect()
    assert sorted(r.id for r in rows if r._corrupt_record is None) == [1, 3] and len(rows) == 3


def test_posts_are_the_same_either_way(spark, tmp_path, ranges):
    posts = [{"post_id": str(i), "text": f'te"xt }} {i}', "score": i, "topic_focus": ["a", "b}"]} for i in range(50)]
    (tmp_path / "a.json").write_text(json.dumps(posts[:20]))
    (tmp_path / "b.json").write_text(json.dumps(posts[20:], indent=1))
    paths = [str(tmp_path / n) for n in ("b.json", "missing.json", "a.json")]
    ranges(128)
    both = [readers.read_posts_json(spark, paths, split=s).select("post_id", "text", "score", "topic_focus", "file_order").collect() for s in (False, True)]
    assert sorted(map(tuple, both[0])) == sorted(map(tuple, both[1])) and len(both[0]) == 50
    assert {r.file_order for r in both[1]} == {0, 2}
