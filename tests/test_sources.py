"""Readers that part files over tasks: fixed records, lines, offsets, row groups, arrays; and scans over ranges."""

import gzip
import json
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan, StringContains

from sparkloom.operators import relational
from sparkloom.plans import reading
from sparkloom.operators.running import last_seen, next_value
from sparkloom.sources import arrays, files, ranges, records, rows, writers


# --- fixed records ----------------------------------------------------------------------------------------------------
def test_records_at_any_split(spark, tmp_path):
    values = np.arange(10_007, dtype="<u4") * 400_000  # above the signed range at the end
    values.tofile(tmp_path / "a.bin")
    (tmp_path / "sub").mkdir()
    values[:5].tofile(tmp_path / "sub" / "b.bin")
    values[:5].tofile(tmp_path / "_hidden")
    for split in (4 * 64, 10_000, 1 << 30):
        df = files.read_tokens(spark, str(tmp_path), 64, split=split)
        got = {(r.path.rsplit("/", 1)[1], r.chunk): r.tokens for r in df.collect()}
        assert got == {**{("a.bin", i): values[i * 64 : i * 64 + 64].tolist() for i in range(157)}, ("b.bin", 0): values[:5].tolist()}
        assert df.rdd.getNumPartitions() == {4 * 64: 158, 10_000: 6, 1 << 30: 2}[split]
    assert files.read_tokens(spark, str(tmp_path), 64, "drop").count() == 156
    with pytest.raises(Exception, match="whole records"):
        files.read_tokens(spark, str(tmp_path), 64, "raise").collect()


def test_record_filters_narrow_the_ranges(tmp_path):
    np.arange(1000, dtype="<f4").tofile(tmp_path / "a.bin")
    np.arange(100, dtype="<f4").tofile(tmp_path / "b.bin")
    a, b = str(tmp_path / "a.bin"), str(tmp_path / "b.bin")

    def read(*filters):
        reader = records.RecordReader({"paths": json.dumps([a, b]), "kind": "<f4", "width": "10", "split": "400"})
        back = list(reader.pushFilters(list(filters)))
        spans = reader.partitions()
        return back, {(s.path[-5:], i) for s in spans for i in range(s.first, s.last)}, [b for s in spans for b in reader.read(s)]

    back, held, batches = read(GreaterThanOrEqual(("record",), 15), LessThan(("record",), 18))
    assert back == [] and held == {("a.bin", 15), ("a.bin", 16), ("a.bin", 17)}
    assert [v for b in batches for v in b.column("numbers").to_pylist()] == [list(range(i * 10, i * 10 + 10)) for i in (15, 16, 17)]
    other = StringContains(("path",), "x")
    back, held, _ = read(other, In(("path",), (b, "c")), GreaterThan(("record",), 7))
    assert back == [other] and held == {("b.bin", 8), ("b.bin", 9)}
    assert read(EqualTo(("record",), 500))[1:] == (set(), [])


def test_many_splits_share_tasks(spark, tmp_path):
    """Small files, or small splits, don't make a task each without end; rows and their numbers stay as they are."""
    values = np.arange(40_003, dtype="<u4")
    for i in range(40):
        values[i * 1000 : i * 1000 + 1000].tofile(tmp_path / f"a{i:02}.bin")
    values.tofile(tmp_path / "b.bin")
    df = files.read_tokens(spark, str(tmp_path), 4, split=16)
    assert df.rdd.getNumPartitions() <= records.TASKS
    held = {f"a{i:02}.bin": values[i * 1000 : i * 1000 + 1000] for i in range(40)} | {"b.bin": values}
    assert {(r.path.rsplit("/", 1)[1], r.chunk): r.tokens for r in df.collect()} == {(f, k): v[k * 4 : k * 4 + 4].tolist() for f, v in held.items() for k in range(-(-len(v) // 4))}
    reader = records.RecordReader({"path": str(tmp_path), "width": "4", "split": str(16), "tail": "keep"})
    reader.split = records.SPLIT
    spans = [records.Span("x", i, i + 1, 0, 9) for i in range(0, 4000, 2)]
    assert [len(p.held) for p in reader._shared(spans)] == [2] * 1000
    big = records.SPLIT // 16
    assert all(len(p.held) == 1 for p in reader._shared([records.Span(str(i), 0, big, 0, big) for i in range(1001)]))  # no task takes more than SPLIT


def test_pushed_filters_reach_the_source(spark, tmp_path):
    np.arange(1000, dtype="<u4").tofile(tmp_path / "a.bin")
    df = files.read_tokens(spark, str(tmp_path), 10, split=40).where("chunk >= 90 and chunk < 92")
    assert sorted(r.chunk for r in df.collect()) == [90, 91]
    assert df.rdd.getNumPartitions() == 2  # of 100


def test_chunks_by_address(spark, tmp_path):
    """Chunks of a group's shards, whose last pieces are in none, in any order and repeated."""
    rng, shards, streams = random.Random(1), [], {}
    for g in ("a", "b"):
        for k in range(5):
            n = rng.randrange(1, 400)
            x = np.array([rng.randrange(1 << 32) for _ in range(n)], "<u4")
            x.tofile(tmp_path / f"{g}{k}.bin")
            shards.append((g, str(tmp_path / f"{g}{k}.bin"), n))
            streams.setdefault(g, []).extend(x[i * 16 : i * 16 + 16].tolist() for i in range(n // 16))
    plan = [(i, g, rng.randrange(len(streams[g]))) for i in range(60) for g in ("a", "b")]
    wanted = spark.createDataFrame(plan, "item int, domain string, chunk long")
    table = spark.createDataFrame(shards, "domain string, path string, tokens long")
    got = ranges.bytes_at(records.chunk_places(wanted, table, 16), "length").select("item", "domain", ranges.numbers(F.col("value"), "<u4").alias("tokens"))
    assert {(r.item, r.domain): r.tokens for r in got.collect()} == {(i, g): streams[g][c] for i, g, c in plan}
    with pytest.raises(IndexError):
        records.chunk_places(spark.createDataFrame([("a", 10_000)], "domain string, chunk long"), table, 16)


# --- lines ------------------------------------------------------------------------------------------------------------
@pytest.fixture
def lines_folder(tmp_path):
    rng = random.Random(4)
    lines = [rng.choice(["", "  ", "\t", "x" * rng.randrange(1, 300), f"é{rng.randrange(99)}  z"]) for _ in range(3000)] + ["end"]
    (tmp_path / "a.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.txt").write_text("\n".join([*lines[:77], "end"]))
    with gzip.open(tmp_path / "c.txt.gz", "wt") as f:
        f.write("\n".join([*lines[100:300], "end"]))
    return tmp_path, {"a.txt": lines, "b.txt": [*lines[:77], "end"], "c.txt.gz": [*lines[100:300], "end"]}


@pytest.mark.parametrize("split", ["1500", "40000", "134217728"])
def test_line_index_at_any_split(spark, lines_folder, split):
    folder, held = lines_folder
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, split)
    try:
        for blank in (False, True):
            got = rows.indexed_lines(spark, str(folder), blank).collect()
            held = {n: x if x[-1] else x[:-1] for n, x in held.items()}  # nothing follows the last newline
            want = {(n, i): x for n, lines in held.items() for i, x in enumerate([x for x in lines if blank or x.strip()])}
            assert {(r.file.rsplit("/", 1)[1], r.row): r.value for r in got} == want and len(got) == len(want)
        offsets = rows.line_offsets(spark, [str(folder / "a.txt"), str(folder / "b.txt")]).collect()
    finally:
        spark.conf.set(key, before)
    want = {}
    for n in ("a.txt", "b.txt"):
        at = 0
        for i, x in enumerate(held[n]):
            want[n, i] = at
            at += len(x.encode()) + 1
    assert {(r.file.rsplit("/", 1)[1], r.row): r.offset for r in offsets} == want


def test_settings_changed_between_the_passes_raise(spark, lines_folder):
    folder, _ = lines_folder
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    df = rows.indexed_lines(spark, str(folder / "a.txt"))
    spark.conf.set(key, "1500")
    try:
        with pytest.raises(Exception, match="split anew"):
            df.collect()
    finally:
        spark.conf.set(key, before)


def test_lines_at_offsets(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    lines = [json.dumps({"i": i, "text": "é" * rng.randrange(2000)}) for i in range(900)]
    (tmp_path / "a.jsonl").write_text("\r\n".join(lines))
    offsets = rows.line_offsets(spark, str(tmp_path / "a.jsonl"))
    wanted = offsets.where("row % 7 = 3 or row = 899").withColumnRenamed("file", "path")
    got = ranges.lines_at(wanted).collect()
    assert {r.row: r.value for r in got} == {i: x for i, x in enumerate(lines) if i % 7 == 3 or i == 899}
    with pytest.raises(Exception, match="past the end"):
        ranges.lines_at(spark.createDataFrame([(str(tmp_path / "a.jsonl"), 10**9)], "path string, offset long")).collect()


def test_places_close_together_take_one_seek(tmp_path, monkeypatch):
    monkeypatch.setattr(ranges, "BLOCK", 64)
    monkeypatch.setattr(ranges, "GAP", 100)
    data = bytes(range(256)) * 40
    (tmp_path / "a").write_bytes(data)
    reader = ranges.Reader(str(tmp_path / "a"))
    for offset, length, seeks in ((10, 5, 1), (12, 200, 1), (150, 10, 1), (300, 3, 1), (5000, 9, 2), (5100, 70, 2), (20, 4, 3)):
        assert reader.bytes_at(offset, length) == data[offset : offset + length] and reader.seeks == seeks
    assert reader.got < 1500
    assert reader.bytes_at(7, 0) == b""
    with pytest.raises(IndexError):
        reader.bytes_at(len(data) - 3, 4)


# --- row groups -------------------------------------------------------------------------------------------------------
def test_only_wanted_row_groups_are_read(spark, tmp_path):
    n = 5000
    table = pa.table({"k": pa.array(range(n)), "s": [f"v{i}" for i in range(n)], "l": [[i, i + 1] for i in range(n)], "x": [0.5] * n})
    path = str(tmp_path / "t.parquet")
    pq.write_table(table, path, row_group_size=300)
    wanted = [0, 299, 300, 301, 4500, 4999, 4999]
    got = rows.rows_at(spark, path, spark.createDataFrame([(w,) for w in wanted], "row long"), ["s", "l", "k"]).collect()
    assert sorted((r.row, r.k, r.s, r.l) for r in got) == [(w, w, f"v{w}", [w, w + 1]) for w in sorted(set(wanted))]
    assert {r.group for r in got} == {0, 1, 15, 16}
    for share in (100, 1):  # what is read falls with what is wanted
        few = spark.range(0, 300 * share // 100).select(F.col("id").alias("row"))
        assert {r.group for r in rows.rows_at(spark, path, few, ["k"]).select("group").distinct().collect()} == {0}
    with pytest.raises(IndexError):
        rows.rows_at(spark, path, spark.createDataFrame([(n,)], "row long"), ["k"])


def test_rows_of_several_files(spark, tmp_path):
    for f in ("a", "b"):
        pq.write_table(pa.table({"k": [f"{f}{i}" for i in range(10)]}), tmp_path / f"{f}.parquet", row_group_size=4)
    paths = [str(tmp_path / f"{f}.parquet") for f in ("a", "b")]
    wanted = spark.createDataFrame([(paths[0], 3), (paths[1], 9)], "path string, row long")
    assert sorted(r.k for r in rows.rows_at(spark, paths, wanted, ["k"]).collect()) == ["a3", "b9"]
    through = spark.createDataFrame([(3,), (10,), (19,)], "row long")  # counted through both
    assert sorted((r.row, r.k) for r in rows.rows_at(spark, str(tmp_path), through, ["k"]).collect()) == [(3, "a3"), (10, "b0"), (19, "b9")]


# --- arrays -----------------------------------------------------------------------------------------------------------
ODD = [{"a": 'x"y\\', "b": [1, [2, {"c": "],["}]]}, "\\", '\\"', "é,[", 17, None, [], {}, [[[",\\\\"]]], {"k\"": {"z": ["}", "{"]}}, "a\\\\\\" + '"', -1.5e3]


@pytest.mark.parametrize("piece", [1, 2, 7, 64, 1 << 20])
def test_array_at_any_piece(spark, tmp_path, piece):
    (tmp_path / "a.json").write_text(" \n" + json.dumps(ODD, indent=1, ensure_ascii=False) + "\n ")
    (tmp_path / "b.json").write_bytes(b"\xef\xbb\xbf" + json.dumps(ODD * 3, separators=(",", ":")).encode())
    (tmp_path / "c.json").write_text(" [ \n ] ")
    got = arrays.read_array(spark, str(tmp_path), piece).collect()
    assert sorted(((r.path.rsplit("/", 1)[1], r.row, json.dumps(json.loads(r.value))) for r in got)) == sorted((f, i, json.dumps(x)) for f, held in (("a.json", ODD), ("b.json", ODD * 3)) for i, x in enumerate(held))


def test_effects_compose():
    rng = random.Random(2)
    for _ in range(300):
        data = json.dumps(rng.sample(ODD, rng.randrange(len(ODD)))).encode()
        cut = sorted(rng.randrange(len(data) + 1) for _ in range(3))
        parts = [data[a:b] for a, b in zip([0, *cut], [*cut, len(data)])]
        assert arrays.effects(iter(parts))[arrays.OUTSIDE] == arrays.effect(data, arrays.OUTSIDE)


@pytest.mark.parametrize("text", ["{}", "", "[1, 2", '["a]', "[1]]", "[1] [2]", "[1,,2]", "17"])
def test_what_is_no_array_raises(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception):
        arrays.read_array(spark, str(tmp_path / "a.json"), 3).collect()


# --- scans over ranges ------------------------------------------------------------------------------------------------
def test_scans_equal_plain_ones(spark):
    rng = random.Random(6)
    data = [(rng.choice([None, "a", "b", "hot", "hot", "hot"]), i, rng.choice([None, None, None, i * 10])) for i in range(2000)] + [("none", 5000 + i, None) for i in range(5)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "g string, o int, v int").repartition(7)
    groups = {}
    for g, o, v in sorted(data, key=lambda r: r[1]):
        groups.setdefault(g, []).append((o, v))
    want_last, want_next = {}, {}
    for g, own in groups.items():
        seen = None
        for i, (o, v) in enumerate(own):
            seen = v if v is not None else seen
            want_last[g, o] = seen
            want_next[g, o] = own[i + 1][1] if i + 1 < len(own) else -1
    assert {(r.g, r.o): r.s for r in last_seen(df, F.col("v"), ["o"], ["g"], "s").collect()} == want_last
    assert {(r.g, r.o): r.s for r in next_value(df, F.col("v"), ["o"], ["g"], F.lit(-1), "s").collect()} == want_next
    whole = sorted(data, key=lambda r: r[1])
    seen, want = None, {}
    for _, o, v in whole:
        seen = v if v is not None else seen
        want[o] = seen
    got = last_seen(df, F.col("v"), ["o"], out="v")  # in place, over the whole table
    assert {r.o: r.v for r in got.collect()} == want and sorted(got.columns) == ["g", "o", "v"]
    assert last_seen(df.limit(0), F.col("v"), ["o"], ["g"]).collect() == []


def test_no_task_sees_a_hot_group_whole(spark):
    df = spark.range(4000).select(F.lit("one").alias("g"), F.col("id").alias("o"), F.when(F.col("id") % 100 == 0, F.col("id")).alias("v"))
    seen = last_seen(df, F.col("v"), ["o"], ["g"], "s").withColumn("task", F.spark_partition_id())
    assert {(r.o, r.s) for r in seen.collect()} == {(i, i // 100 * 100) for i in range(4000)}
    from sparkloom.operators.running import _ranged

    d, part = _ranged(df, [F.col("o")], ["g"])
    sizes = [r.n for r in d.groupBy("g", part).agg(F.count("*").alias("n")).collect()]  # what a window over a range holds
    assert len(sizes) == 4 and max(sizes) < 2000


def test_segments_end_at_the_final_step(spark):
    df = spark.createDataFrame([("a", 0), ("a", 7), ("b", 3)], "run string, step long")
    assert sorted(map(tuple, relational.segments(df, "run", "step", 10).collect())) == [("a", 0, 7), ("a", 7, 3), ("b", 3, 7)]


def test_truncated_compressed_file_fails(spark, tmp_path):
    """SC-03: no part of a file that ends early is taken for the whole."""
    whole = gzip.compress(b'{"text": "words"}\n' * 50_000)
    (tmp_path / "a.jsonl.gz").write_bytes(whole[: len(whole) // 2])
    with pytest.raises(Exception):
        files.read_lines(spark, str(tmp_path / "a.jsonl.gz")).count()


# --- writers ----------------------------------------------------------------------------------------------------------
def test_pieces_are_written_and_marked_by_tasks(spark, tmp_path, monkeypatch):
    """The driver does nothing for each piece; what has no mark is written again, in place of what was there."""
    def never(*_):
        raise AssertionError("a piece went through the driver")

    monkeypatch.setattr(writers, "write_json", never)
    monkeypatch.setattr(writers, "exists", never)
    path = f"file://{tmp_path}/p"
    df = writers.capped_pieces(spark.range(1000).select("id", (F.col("id") % 7 * 10).alias("size")), F.col("size"), 100, "id")
    want = sorted((r.id, r.size, r.piece) for r in df.collect())
    pieces = sorted({p for _, _, p in want})
    assert sorted(r.piece for r in writers.write_pieces(df, path, "id").collect()) == pieces
    for p in (0, 5):
        (tmp_path / "p" / f"{p}.{writers.DONE}").unlink()
    (tmp_path / "p" / "pieces" / "piece-5.parquet").write_bytes(b"cut short")
    assert sorted(r.piece for r in writers.write_pieces(df, path, "id").collect()) == [0, 5]
    assert writers.write_pieces(df, path, "id").count() == 0
    assert sorted((r.id, r.size, r.piece) for r in writers.read_pieces(spark, path, "id long, size long").collect()) == want
    assert sorted(int(f.name.split(".")[0]) for f in (tmp_path / "p").glob("*.json")) == pieces


def test_array_files_are_bounded(spark, tmp_path):
    """A language of many bytes has many files, each one JSON array; none is one task's work whole."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 > 0, "en").when(F.col("id") > 0, "fr").alias("lang"), F.lpad(F.col("id").cast("string"), 100, '"').alias("text"))
    placed = reading.array_files(docs, 4000)
    assert {r.lang: r.n for r in placed.groupBy("lang").agg(F.count_distinct("piece").alias("n")).collect()} == {"en": 10, "fr": 1, None: 1}
    raw = placed.select("piece", "doc_id", F.encode(F.to_json(F.struct("doc_id", "lang", "text")), "utf-8").alias("raw"))
    written = writers.write_raw(raw, f"file://{tmp_path}/a", "piece", "doc_id", frame=(b"[", b"\n,", b"\n]\n")).collect()
    assert all(len((tmp_path / "a" / r.path.rsplit("/", 1)[1]).read_bytes()) == r.bytes < 12_000 for r in written)
    got = arrays.parsed(arrays.read_array(spark, f"file://{tmp_path}/a", 700), "doc_id long, lang string, text string")
    assert sorted((r.doc_id, r.text) for r in got.collect()) == sorted((r.doc_id, r.text) for r in docs.collect())
