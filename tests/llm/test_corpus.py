"""Near duplicates, sharding, archives, and the pipeline."""

import gzip
import hashlib
import itertools
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer

import corpus_pipeline
from lodestream.llm import entries, neardup, pii, sharding, toxicity, warc


def sets_of(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return set()
    return {tuple(words)} if len(words) < 4 else {tuple(words[i : i + 4]) for i in range(len(words) - 3)}


def brute_components(rows):
    """component_id by doc_id, comparing all pairs."""
    ids = sorted({r[0] for r in rows})
    sets = {r[0]: sets_of(r[1]) for r in rows}
    comp = {i: i for i in ids}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a in ids:
        for b in ids:
            x, y = sets[a], sets[b]
            if a < b and x and y and 100 * len(x & y) >= 80 * len(x | y):
                ra, rb = root(a), root(b)
                comp[max(ra, rb)] = min(ra, rb)
    return {i: root(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def near_copies(seed, groups=6, size=14, words=60):
    """Groups of edited copies, whose similarities lie on both sides of the threshold, and copies of them."""
    rng = random.Random(seed)
    rows, i = [], 0
    for g in range(groups):
        base = [f"w{g}_{k}" for k in range(words)]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
            rows.append((i, " ".join(own)))
            i += rng.randint(1, 3)
    rows += [(i + k, rng.choice(rows)[1].upper()) for k in range(10)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_against_all_pairs(spark, seed):
    rows = near_copies(seed)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    comp, sizes = brute_components(rows)
    assert {r.doc_id: r.component_id for r in got} == comp
    assert {r.doc_id: r.n_shingles for r in got} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_families_within_one_bucket(spark, monkeypatch):
    """Texts of one page frame in families that are alike only within: hubs settle them family by family."""
    rng = random.Random(5)
    frame = [f"frame{k}" for k in range(70)]
    rows = []
    for g in range(5):
        own = frame + [f"g{g}_{k}" for k in range(28)]
        for _ in range(12):
            words = list(own)
            words[rng.randrange(98)] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    rounds = []
    hubs = neardup._hub_pairs
    monkeypatch.setattr(neardup, "_hub_pairs", lambda *a: rounds.append(1) or hubs(*a))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    comp, _ = brute_components(rows)
    assert {r.doc_id: r.component_id for r in got} == comp and len(set(comp.values())) >= 5
    assert len(rounds) >= 1


def test_near_duplicates_of_odd_rows(spark, docs, no_docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    comp, _ = brute_components([r for r in rows if r[0] is not None])
    assert all(r.component_id == comp[r.doc_id] for r in got if r.doc_id is not None)
    nulls = [r for r in got if r.doc_id is None]
    assert sorted((r.n_shingles == 0, r.component_id is None, r.kept) for r in nulls) == [(False, False, False), (True, True, True)]
    assert neardup.near_duplicates(no_docs).collect() == []
    kept = neardup.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and set(ids) == {r.component_id for r in got if r.doc_id is not None}


def test_verdicts_are_for_one_id_and_text(spark):
    """A row that is dropped takes no other text of its doc_id, null or repeated, with it."""
    text = lambda k, last="z": " ".join([*(f"{k}{i}" for i in range(40)), last])
    rows = [(3, text("a")), (None, text("a", "y")), (None, text("b")), (None, text("c")), (None, None), (5, text("d")), (5, text("a", "x")), (8, text("d", "y")), (5, text("d")), (9, text("e"))]
    kept = neardup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = [(3, text("a")), (None, text("b")), (None, text("c")), (None, None), (5, text("d")), (9, text("e"))]
    assert sorted(map(tuple, kept), key=repr) == sorted(want, key=repr)


def test_tables_are_freed(spark, tmp_path, monkeypatch):
    """What a result no longer needs is deleted before it is returned."""
    from lodestream.llm import common

    monkeypatch.setattr(common, "shared_folder", lambda spark: f"file://{tmp_path}")
    base = [f"w{i}" for i in range(60)]
    df = spark.createDataFrame([(k, " ".join(base[: 60 - k % 5])) for k in range(20)], "doc_id long, text string")
    assert neardup.deduplicated(df).count() < 20
    assert len(list(tmp_path.iterdir())) == 1
    assert neardup.near_duplicates(df).count() == 20
    assert len(list(tmp_path.iterdir())) == 3
    with common.passing(spark) as keep:
        one, two = common.stored(df, "one"), common.stored(df, "two")
        keep(two._lodestream_path)
    assert two.count() == 20 and len(list(tmp_path.iterdir())) == 4 and not any("-one-" in p.name for p in tmp_path.iterdir())


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(0)
    for n in (1, 3, 40, 600):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: max(1, n * 8 // 10)], rng.integers(0, 2**63, n // 5).astype(np.uint64)]))
        x, y = neardup.sketch(a), neardup.sketch(b)
        assert x.max() < np.iinfo(np.uint64).max and len(x) == neardup.COORDINATES
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((x == y).mean() - true) < 0.15
        assert (neardup.sketch(a[::-1].copy()) == x).all()


def brute_shards(rows, shards):
    """(doc_id, text) -> shards, by walking all rows in key order: the middle of each group, or row of a heavy group, decides."""
    hashed = sorted((int(hashlib.md5((t or "").encode()).hexdigest()[:15], 16), -(1 << 63) if d is None else d, d, t) for d, t in rows)
    size = lambda r: len((r[3] or "").encode()) + 1
    total = sum(map(size, hashed))
    targets = [total * k // shards for k in range(1, shards)]
    out, below = [], 0
    for _, group in itertools.groupby(hashed, key=lambda r: r[0]):
        group = list(group)
        w = sum(map(size, group))
        parts = [group] if w <= total // shards // sharding.GROUP_PART else [[r] for r in group]
        for part in parts:
            w = sum(map(size, part))
            out += [(r[2], size(r), sum(2 * t <= 2 * below + w for t in targets)) for r in part]
            below += w
    return Counter(out)


@pytest.mark.parametrize("slice_rows", [7, 10_000])
@pytest.mark.parametrize("seed", range(3))
def test_sharding(spark, docs, no_docs, slice_rows, seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(sharding, "BITS", rng.choice([2, 5, 12]))
    rows = [(i, "same text " * 3 if i % 3 == 0 else "y" * rng.randint(0, 400)) for i in range(900)] + [(5, "dup"), (5, "dup"), (None, None), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = sharding.sharded(df, 8, slice_rows=slice_rows).collect()
    assert Counter((r.doc_id, r.size, r.shard) for r in got) == brute_shards(rows, 8)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    total = sum(r.size for r in got)
    for s in range(8):
        assert sorted(r.slot for r in by[s]) == list(range(len(by[s])))
        assert abs(sum(r.size for r in by[s]) - total / 8) <= 402 + total / 8 / sharding.GROUP_PART
    texts = {r[0]: r[1] for r in rows if r[0] not in (5, 7, None)}
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in got if r.doc_id in texts)
    assert sharding.sharded(no_docs).collect() == []
    odd = sharding.sharded(docs, 3).collect()
    assert Counter((r.doc_id, r.size, r.shard) for r in odd) == brute_shards([(r.doc_id, r.text) for r in docs.collect()], 3)


@pytest.mark.parametrize("rows", [[(1, "a")], [(1, "x")] * 40, [(i, "x") for i in range(40)], [(None, None)] * 9, [((1 << 63) - 1, "x"), (-(1 << 63), "x"), (0, "x")] * 4])
def test_sharding_of_few_texts(spark, rows):
    got = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert Counter((r.doc_id, r.size, r.shard) for r in got) == brute_shards(rows, 4)


def test_sharding_stays_in_the_jvm(spark, docs):
    plan = sharding.sharded(docs.select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert "Scan ExistingRDD" not in plan and "Python" not in plan and "Arrow" not in plan


def test_equal_texts_stay_together(spark):
    rows = [(i, f"text {i // 2} " * 5) for i in range(4000)]
    got = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    shard = {r.doc_id: r.shard for r in got}
    assert all(shard[i] == shard[i + 1] for i in range(0, 4000, 2))


TRAP = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"


def page_rows():
    long = "<p>é" + "x" * 5000
    return [(0, "u0", "a" * 200), (1, "u1", "a" * 200), (2, None, None), (3, "u3", ""), (4, "u4", "short"), (5, "u5", "short"), (6, "u6", long), (7, "u7\r\nX: y", long), (8, "u8", TRAP * 3), (9, "u9", "x\n" + TRAP + "WARC/1.1\r\n"), (10, "u", "\r\n\r\n" + TRAP), (-4, "n", "a" * 200), (None, "z", "b" * 300), (11, "z", "b" * 300)]


def test_warc_round_trip(spark):
    df = spark.createDataFrame([(*r, "extra", "t") for r in page_rows()], "page_id long, url string, html string, digest string, type string").repartition(3)
    got = {r.page_id: r for r in warc.round_trip(df).collect()}
    assert len(got) == len(page_rows())
    for page, _, html in page_rows():
        body = (html or "").encode()
        assert (got[page].payload_bytes, got[page].payload_digest) == (len(body), hashlib.sha256(body).hexdigest())
    assert (got[0].record_type, got[0].refers_to) == ("revisit", -4) == (got[1].record_type, got[1].refers_to)
    assert got[-4].record_type == got[5].record_type == got[11].record_type == "response"
    assert (got[7].record_type, got[7].refers_to) == ("revisit", 6)
    assert (got[None].record_type, got[None].refers_to) == ("revisit", 11)
    assert warc.round_trip(df.filter("page_id > 1000")).collect() == []


def test_warc_long_urls(spark, tmp_path):
    rows = [(i, "data:" + "u" * (40_000 if i == 4 else 3), f"page {i} " * 30) for i in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    assert sorted(r.page_id for r in warc.round_trip(df).collect()) == list(range(12))
    warc.write(df, str(tmp_path / "whole"))
    assert {r.url for r in warc.read(spark, str(tmp_path / "whole")).collect()} == {r[1] for r in rows}
    for name, data in (("cut", TRAP * 3 + TRAP[:-5]), ("short", TRAP * 2 + TRAP[:-4]), ("broken", TRAP + "x" + TRAP), ("none", "hello\r\n\r\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc").write_text(data, newline="")
        with pytest.raises(Exception, match="doesn't end at the archive's last byte"):
            warc.read(spark, str(tmp_path / name)).collect()
        with gzip.open(tmp_path / name / "b.warc.gz", "wb") as f:
            f.write(data.encode())
        (tmp_path / name / "a.warc").unlink()
        if name != "short":
            with pytest.raises(Exception, match="no record at byte"):
                warc.read(spark, str(tmp_path / name)).collect()


def test_warc_of_other_ids(spark):
    rows = [("a/b c", "u", "x" * 120), ("é>", "u", "x" * 120), ("", "u", "y"), (None, "u", "x" * 120), ("null", "u", "z")]
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.round_trip(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()}
    assert got == {"a/b c": ("response", None), "é>": ("revisit", "a/b c"), "": ("response", None), None: ("revisit", "a/b c"), "null": ("response", None)}


def archive(rng, n):
    """(bytes, [(offset, block)]): records whose blocks hold magic, whole records, line ends, or nothing."""
    out, at, records = [], 0, []
    for i in range(n):
        block = rng.choice([b"", b"\r\n", b"\r\n\r\n", b"x\r\n", TRAP.encode() * rng.randint(1, 6), b"\r\n\r\n" + TRAP.encode(), b"y" * rng.randint(0, 900), bytes(rng.randrange(256) for _ in range(30)), b"\r\n\r\nWARC/1.1\r\nContent-Length: 900\r\n\r\nz"])
        record = f"WARC/1.{i % 2}\r\nWARC-Type: resource\r\nWARC-Target-URI: {'u' * rng.choice([1, 700])}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
        records.append((at, block))
        out.append(record)
        at += len(record)
    return b"".join(out), records


@pytest.mark.parametrize("size", [100, 2000, 1 << 27])
def test_archives_in_ranges(spark, tmp_path, size):
    """However small the ranges that tasks read, the records are those that were written; packed archives among them."""
    rng = random.Random(size)
    want = set()
    for k in range(3):
        data, records = archive(rng, 25)
        name = f"a{k}.warc" + (".gz" if k == 2 else "")
        (tmp_path / name).write_bytes(gzip.compress(data[: len(data) // 2]) + gzip.compress(data[len(data) // 2 :]) if k == 2 else data)
        want |= {(name, at, block, hashlib.sha256(block).hexdigest()) for at, block in records}
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}
    try:
        spark.conf.set(keys[0], str(size))
        spark.conf.set(keys[1], "0")
        got = warc.read(spark, str(tmp_path)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got) == 75
    assert {(r.path.rsplit("/", 1)[1], r.offset, bytes(r.block), r.block_sha256) for r in got} == want


def expected_pages(rows):
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of rows (page_id, url, html) with page_ids of their own."""
    least, n = {}, Counter((html or "").encode() for _, _, html in rows)
    for page, _, html in rows:
        body = (html or "").encode()
        least[body] = min(page, least.get(body, page))
    out = set()
    for page, _, html in rows:
        body = (html or "").encode()
        again = len(body) >= 100 and n[body] > 1 and page != least[body]
        out.add((page, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", least[body] if again else None))
    return out


@pytest.mark.parametrize("size, broadcast", [(20_000, True), (20_000, False), (1 << 27, True)])
def test_round_trip_follows_chains_across_ranges(spark, monkeypatch, size, broadcast):
    """The archives that a round trip writes are read in ranges, however small, and by pointer jumping between these."""
    rng = random.Random(size)
    bodies = [None, "", "short", "é" * 50, "x" * 99, "x" * 100, TRAP * 3, "\r\n\r\n" + TRAP * 2, "y\r\n", "<p>" + "z" * 30_000]
    rows = [(i, f"u{i}", rng.choice(bodies) if i % 3 else f"page {i} " * rng.randint(1, 60)) for i in range(150)]
    seen, real = [], warc.first_records

    def spy(runs, files):
        out = real(runs, files)
        seen.extend(out.collect())
        return out

    monkeypatch.setattr(warc, "first_records", spy)
    if not broadcast:
        monkeypatch.setattr(warc, "BROADCAST_BYTES", -1)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}
    try:
        spark.conf.set(keys[0], str(size))
        spark.conf.set(keys[1], "0")
        got = [tuple(r) for r in warc.round_trip(df).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got) == 150 and set(got) == expected_pages(rows)
    assert seen and all(r.ends for r in seen)
    if size < 1 << 27:
        assert any(r.start and r.first is not None for r in seen) and any(r.open is not None for r in seen)


def test_warc_plain_and_packed(spark, tmp_path):
    """Plain archives hold the records byte for byte, in one file a task; packed ones are bounded and read alike."""
    df = spark.createDataFrame(page_rows(), "page_id long, url string, html string").coalesce(1)
    warc.write(df, str(tmp_path / "plain"))
    warc.write(df, str(tmp_path / "packed"), records_per_file=4, packed=True)
    (plain,) = [p.read_bytes() for p in (tmp_path / "plain").iterdir() if p.name.startswith("part-")]
    packed = [gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "packed").iterdir()) if p.name.startswith("part-")]
    assert plain.startswith(b"WARC/1.1\r\nWARC-Type: ") and plain.endswith(b"\r\n\r\n")
    assert len(packed) == 4 and sorted(map(len, packed)) != [0] * 4 and sum(map(len, packed)) == len(plain)
    a, b = (sorted(((r.record_id, r.type, r.refers_to, bytes(r.block), r.block_bytes, r.block_sha256) for r in warc.read(spark, str(tmp_path / n)).collect()), key=str) for n in ("plain", "packed"))
    assert a == b and len(a) == len(page_rows())
    assert all(n == len(block) and digest == hashlib.sha256(block).hexdigest() for *_, block, n, digest in a)
    assert "block" not in warc.read(spark, str(tmp_path / "plain"), blocks=False).columns


def test_chain_ends():
    rng = random.Random(0)
    for _ in range(300):
        places = sorted(rng.sample(range(400), rng.randint(0, 40)))
        after = [rng.choice([p for p in places if p > x] + [400, 407]) if rng.random() < 0.9 else x + 1 for x in places]
        step = dict(zip(places, after, strict=True))
        want = {}
        for x in places:
            last, at = x, x
            while at in step:
                last, at = at, step[at]
            if at > places[-1]:
                want[x] = (last, at)
        assert warc.chain_ends(list(zip(places, after, strict=True))) == want
    assert warc.header(TRAP.encode())[1:] == (TRAP.index("hi"), 2)
    for bad in ("xWARC/1.0\r\nContent-Length: 7\r\n\r\n", "WARC/1.0\r\nno header\r\nContent-Length: 7\r\n\r\n", "WARC/1.0\r\n\r\n", "WARC/1.0\r\nContent-Length: 7\r\n"):
        assert warc.header(bad.encode()) is None


@pytest.mark.parametrize("name", sorted(entries.oracle_sql()))
def test_queries_equal_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = entries.queries()[name](spark, sf)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({entries.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(map(tuple, want), key=repr)


def test_pipeline_stages(spark, docs, no_docs, tmp_path):
    """Each stage on odd rows and on none; clashing columns keep their own values."""
    rng = random.Random(9)
    passage = " ".join(f"b{rng.randrange(10**6)}" for _ in range(30))
    spark.createDataFrame([(0, passage), (1, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(0, 1, 0), (1, None, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    extra = [(900, "you idiot, you stupid moron", "en", "s", 27), (901, f"x {passage} y", "en", "s", 9), (902, "mail me at a.b@c.example.com today", "en", "s", 34)]
    more = spark.createDataFrame([(*r, *docs.first()[5:]) for r in extra], docs.schema)
    for source, want in ((docs.unionByName(more), None), (no_docs, 0)):
        stage_docs = source
        for name, stage in corpus_pipeline.STAGES:
            before = stage_docs
            out = stage(spark, before, str(tmp_path))
            out.write.mode("overwrite").parquet(str(tmp_path / f"out-{name}-{want}"))
            stage_docs = spark.read.parquet(str(tmp_path / f"out-{name}-{want}"))
            if name != "bpe":
                assert stage_docs.columns == source.columns
                assert {tuple(r)[5:] for r in stage_docs.collect()} <= {tuple(r)[5:] for r in source.collect()}
            if want is not None:
                assert stage_docs.count() == 0
                continue
            ids = {r.doc_id for r in stage_docs.collect()}
            if name == "toxicity":
                assert 900 not in ids and len(ids) == len({r.doc_id for r in before.collect()}) - 1
            if name == "minhash_near_dedup":
                assert {901, 902} <= ids and stage_docs.count() < before.count()
            if name == "benchmark_decontamination":
                assert 901 not in ids and 902 in ids and stage_docs.count() == before.count() - 1
            if name == "pii":
                r = stage_docs.filter("doc_id = 902").first()
                assert r.text == "mail me at [EMAIL] today" and r.n_chars == len(r.text) and stage_docs.count() == before.count()
    assert stage_docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def overlaps_any(text, items):
    """Whether some window of an item agrees with the text's words, by comparing every alignment."""
    words_of = lambda t: [w for w in regex.split(r"[^\p{L}\p{N}]+", (t or "").lower()) if w]
    ws = words_of(text)
    for item in map(words_of, items):
        size = min(20, len(item))
        for shift in range(-len(item), len(ws) + 1) if item else ():
            agree = [0 <= j + shift < len(ws) and ws[j + shift] == w for j, w in enumerate(item)]
            if sum(agree) * 100 >= 80 * size and any(sum(agree[k : k + size]) * 100 >= 80 * size for k in range(len(item) - size + 1)):
                return True
    return False


def test_pipeline_against_brute_force(spark):
    """All rows of the pipeline, each stage done by another way over what the stage before it kept."""
    sf = "/root/testdata/sf0.001"
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    model = toxicity.trained(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    scorer = toxicity.Scorer(model)
    clean = [(i, t) for i, t in rows if scorer.score(scorer.features(t)[0]) < 0.5]
    comp, _ = brute_components(clean)
    single = [(i, t) for i, t in clean if comp[i] == i]
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    fresh = [(i, t) for i, t in single if not overlaps_any(t, items)]
    weights = pii.trained(docs.filter(docs.doc_id.isin([i for i, _ in fresh])))
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = set()
    for i, t in fresh:
        base = pii.base_spans(t or "")
        ids = library.encode(pii.redacted(t or "", sorted(base + pii.added_spans(t or "", base, weights))), add_special_tokens=False).ids
        want.add((i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert len(rows) > len(clean) > len(single) > len(fresh)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_pandas_is_not_needed_by_native_operators(spark):
    """quality, decontamination and sharding run no Python in their plans."""
    sf = "/root/testdata/sf0.001"
    for name in ("op1_quality", "op6_decontamination", "op7_sharding"):
        plan = entries.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas")), name
