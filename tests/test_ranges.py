"""Large arrays in files, read in ranges however small."""

import json
import random

import pytest

from lodestream.sources.ranges import adjacent_records, array_elements, step


def _value(rng, depth=3):
    kind = rng.randrange(8 if depth else 5)
    if kind == 5:
        return [_value(rng, depth - 1) for _ in range(rng.randrange(4))]
    if kind > 5:
        return {k: _value(rng, depth - 1) for k in rng.sample(["a", "b,c", 'd"', "e\\", "]}"], rng.randrange(4))}
    return rng.choice([1, -2.5, None, True, "x,y", 'say "hi, you"', "\\", ",,,", "é,\n", "", "[{", "w," * 60])


@pytest.mark.parametrize("size", [7, 40, 900, 1 << 27])
def test_elements_by_ranges(spark, tmp_path, size):
    rng = random.Random(size)
    want = {}
    for k, n in enumerate((0, 1, 30, 60)):
        items = [_value(rng) for _ in range(n)]
        text = json.dumps(items, ensure_ascii=False, indent=rng.choice([None, 1]))
        (tmp_path / f"f{k}.json").write_text(("﻿" if k == 2 else " \n") + text + "\n", encoding="utf-8")
        want[f"f{k}.json"] = items
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}
    try:
        spark.conf.set(keys[0], str(size))
        spark.conf.set(keys[1], "0")
        got = array_elements(spark, str(tmp_path)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for name, items in want.items():
        own = sorted((r for r in got if r.path.endswith(name)), key=lambda r: r.start)
        assert [json.loads(r.value) for r in own] == items


@pytest.mark.parametrize("size", [9, 60, 1 << 27])
def test_records_by_ranges(spark, tmp_path, size):
    rng = random.Random(size)
    want = {}
    for k, n in enumerate((0, 1, 40, 40)):
        items = [_value(rng) for _ in range(n)]
        gaps = (" ", "\n", "\r\n\t ")
        text = "".join(json.dumps(x, ensure_ascii=False, indent=rng.choice([None, 1])) + rng.choice(gaps) for x in items)
        text = text.rstrip() if k == 3 else text
        (tmp_path / f"f{k}.json").write_text(text, encoding="utf-8", newline="")
        want[f"f{k}.json"] = (items, text.encode())
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}
    try:
        spark.conf.set(keys[0], str(size))
        spark.conf.set(keys[1], "0")
        got = adjacent_records(spark, str(tmp_path)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for name, (items, src) in want.items():
        own = sorted((r for r in got if r.path.endswith(name)), key=lambda r: r.start)
        assert [json.loads(r.value) for r in own] == items
        assert all(src[r.start :].startswith(r.value.encode()) for r in own)
    (tmp_path / "cut.json").write_text('{"a": 1} {"b": [')
    with pytest.raises(Exception, match="isn't closed"):
        adjacent_records(spark, str(tmp_path / "cut.json")).collect()


@pytest.mark.parametrize("text", ['[1, 2, "x]', "[1, [2]", '{"a": [1, 2]}'])
def test_files_without_a_whole_array(spark, tmp_path, text):
    (tmp_path / "bad.json").write_text(text)
    with pytest.raises(Exception, match="isn't closed|no array at the root"):
        array_elements(spark, str(tmp_path)).collect()


def test_steps_for_both_beginnings():
    assert step(b'{"a": [1', False) == (False, 2) and step(b'x"}]', True) == (False, -2)
    assert step(b'"open \\" [', False) == (True, 0) and step(b"still, [", True) == (True, 0)
    assert step(b'shut" ] "again {', True) == (True, -1)
