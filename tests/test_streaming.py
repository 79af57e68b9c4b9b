"""Streaming: the batch operators on streams, counts with state, and a growing file."""

import pytest

from lodestream.functions.values import Number
from lodestream.plans.model import Compare, Filter, Oracle, Project
from lodestream.streaming import records


def drained(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.table(name).collect()


def test_rows_and_counts(spark, tmp_path):
    src = tmp_path / "in"
    batch = spark.createDataFrame([(i, f"2024-01-01 00:{i:02d}:00", f'{{"k": {i}, "xs": [{",".join("1" * (i % 3))}]}}') for i in range(30)], "id int, t string, doc string")
    batch.selectExpr("id", "cast(t as timestamp) ts", "doc").write.parquet(str(src))
    stream = lambda: spark.readStream.schema("id int, ts timestamp, doc string").parquet(str(src))
    got = drained(records.rows(stream(), "doc", Filter((), Compare("ge", "k", Number("20")), ("k",)), keep=["id"]), "rows_out")
    assert sorted(int(r.k) for r in got) == list(range(20, 30))
    counts = drained(records.running_count(stream().selectExpr("id % 2 as half", "doc"), "doc", Oracle("count"), ["half"]), "counts_out", "complete")
    assert {r.half: r.n for r in counts} == {0: 30, 1: 30}
    windows = drained(records.windowed_count(stream(), "doc", Oracle("count"), "ts", "10 minutes", "0 seconds"), "windows_out")
    assert sum(r.n for r in windows) in (40, 60)


@pytest.mark.parametrize(("framing", "before", "after"), [("ndjson", "", "\n"), ("ndjson", "", "\r\n"), ("jsonseq", "\x1e", "\n"), ("adjacent", "", " ")])
def test_growing_file(spark, tmp_path, framing, before, after):
    """What is complete is read, by several tasks; a cut record waits until its end is written."""
    path = tmp_path / "grow.json"
    one = lambda i: f'{before}{{"a":{i}}}{after}'
    path.write_bytes(("".join(map(one, range(30))) + one(30)[:-4]).encode())
    records.register(spark)
    df = spark.readStream.format("lodestream_growing").option("path", str(path)).option("framing", framing).option("bytes", "37").load()
    name = "grow_out"
    q = records.rows(df, "value", Project((), ("a",)), keep=["start"]).writeStream.format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
        size = len(one(0))
        first = sorted((r.start, int(r.a)) for r in spark.table(name).collect())
        assert [a for _, a in first] == list(range(30)) and [s for s, _ in first[:10]] == [i * size + len(before) for i in range(10)]
        with path.open("ab") as f:
            f.write((one(30)[-4:] + one(31) + one(32)).encode())
        q.processAllAvailable()
        # The last payload behind a separator may still go on.
        assert sorted(int(r.a) for r in spark.table(name).collect()) == list(range(32 if framing == "jsonseq" else 33))
    finally:
        q.stop()


def test_ranges_of_a_growing_file(tmp_path):
    """However the file is cut, each record is read once."""
    path = tmp_path / "f"
    for framing, text in (("ndjson", b'{"a":1}\r\n\n[2,\t3]\n"x"\r4\n'), ("jsonseq", b"\x1e1\n\x1e\x1e[2]\n\x1e3")):
        path.write_bytes(text)
        want = None
        for size in (1, 2, 3, 5, 100):
            reader = records._GrowingRanges({"path": str(path), "framing": framing, "bytes": str(size)})
            end = reader.latestOffset()
            rows = [r for p in reader.partitions({"byte": 0}, end) for r in reader.read(p)]
            want = rows if want is None else want
            assert rows == want and [v for _, v in rows] == (['{"a":1}', "[2,\t3]", '"x"', "4"] if framing == "ndjson" else ["1", "[2]"])
