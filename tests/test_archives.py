import random
import zipfile
import zlib

import numpy as np
import pytest
from millrace.operators import archives
from millrace.operators.offsets import running
from millrace.sources import ranges
from millrace.sources.archive import build_zip
from pyspark.sql import functions as F

SCHEMA = "o long, p long, name string, data binary"


def test_checksums_of_parts():
    rng = random.Random(1)
    for _ in range(50):
        a, b = (bytes(rng.randrange(256) for _ in range(rng.randrange(40))) for _ in range(2))
        after = archives.moved(np.array([zlib.crc32(a)], np.uint64), np.array([len(b)]))
        assert int(after[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)
        assert archives.moved(after, np.array([-len(b)]))[0] == zlib.crc32(a)
    zeros = archives.moved(np.array([zlib.crc32(b"x")], np.uint64), np.array([1 << 20]))
    assert int(zeros[0]) ^ zlib.crc32(bytes(1 << 20)) == zlib.crc32(b"x" + bytes(1 << 20))


def test_running_sums(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(3), rng.randrange(5) or None, rng.randrange(9)) for _ in range(300)] + [(7, 1, 1)] * 100
    frame = spark.createDataFrame(rows, "g int, k int, n int").repartition(6)
    got = running(frame, ["k"], "n", "s", ["g"], "t").collect()
    for g in {r.g for r in got}:
        own = sorted((r for r in got if r.g == g), key=lambda r: (r.k is not None, r.k or 0, r.s))
        total = 0
        for r in sorted(own, key=lambda r: (r.s, r.n != 0)):
            assert r.s == total
            total += r.n
        assert {r.t for r in own} == {total} and [r.s for r in own] == sorted(r.s for r in own)
    assert sorted(r.i for r in running(frame, ["g", "k"], to="i").collect()) == list(range(400))
    assert running(frame.limit(0), ["k"], "n", "s", ["g"], "t").collect() == []


def written(spark, path, rows, **more):
    frame = spark.createDataFrame([(o, p, n, d and bytearray(d)) for o, p, n, d in rows], SCHEMA).repartition(5)
    archives.write_archive(frame, str(path), ["o"], ["p"], **more)
    return path.read_bytes()


def test_equal_to_an_archive_made_at_once(spark, tmp_path):
    rng = random.Random(3)
    rows = [(o, p, f"é {o}.md", bytes(rng.randrange(256) for _ in range(rng.randrange(2000)))) for o in range(40) for p in range(rng.randrange(1, 6))]
    rows += [(50, 0, "empty", None), (51, 0, "again", b"x"), (52, 0, "again", b"y" * 100_000)]
    whole = {}
    for o, p, name, data in sorted(rows, key=lambda r: r[:2]):
        whole.setdefault(o, [name, b""])[1] += data or b""
    data = written(spark, tmp_path / "a.zip", rows)
    assert data == build_zip([tuple(x) for _, x in sorted(whole.items())])
    with zipfile.ZipFile(tmp_path / "a.zip") as z:
        assert z.testzip() is None and len(z.namelist()) == 43
    with pytest.raises(Exception):
        written(spark, tmp_path / "a.zip", rows)
    assert written(spark, tmp_path / "a.zip", rows[:1], overwrite=True) == build_zip([(rows[0][2], b"".join(r[3] for r in rows[:1]))])


def test_no_entries_and_too_many(spark, tmp_path, monkeypatch):
    assert written(spark, tmp_path / "none.zip", []) == build_zip([])
    monkeypatch.setattr(archives, "MOST_ENTRIES", 1)
    with pytest.raises(ValueError):
        written(spark, tmp_path / "b.zip", [(1, 1, "a", b""), (2, 1, "b", b"")])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["none.zip"]


def test_only_wanted_ranges_are_read(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "big.zip", "w") as z:
        for k in range(50):
            z.writestr(f"{k}.txt", bytes([k]) * 100_000)
        z.writestr("packed.txt", b"packed " * 5000, zipfile.ZIP_DEFLATED)
    (tmp_path / "no.zip").write_bytes(b"nothing of the kind" * 10)
    (tmp_path / "empty.zip").write_bytes(build_zip([]))
    entries = ranges.archives_at(spark, str(tmp_path))
    assert entries.where("name IS NULL").select("error").distinct().count() == 2
    assert entries.agg(F.sum("bytes_read")).first()[0] < 80_000
    found = ranges.entry_contents(entries.where("name IN ('7.txt', 'packed.txt')")).collect()
    assert {r.name: bytes(r.content) for r in found} == {"7.txt": b"\x07" * 100_000, "packed.txt": b"packed " * 5000}
    assert sum(r.bytes_read for r in found) < 110_000 and all(r.problem is None for r in found)


def test_damage_is_a_problem_of_its_own_entry(spark, tmp_path):
    data = bytearray(build_zip([("a", b"one"), ("b", b"two"), ("c", b"three")]))
    data[0] ^= 1
    data[data.index(b"two")] ^= 1
    (tmp_path / "x.zip").write_bytes(data)
    found = {r.name: r for r in ranges.entry_contents(ranges.archives_at(spark, str(tmp_path))).collect()}
    assert bytes(found["c"].content) == b"three"
    assert found["a"].problem == "no local header" and found["b"].problem == "another checksum" and found["a"].content is None
    large = ranges.entry_contents(ranges.archives_at(spark, str(tmp_path)).where("name = 'c'"), most=2).first()
    assert large.content is None and "over 2 bytes" in large.problem


def test_a_directory_beyond_the_last_bytes(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "many.zip", "w") as z:
        for k in range(2000):
            z.writestr(f"a name of some length {k:05d}.txt", b"")
    rows = ranges.archives_at(spark, str(tmp_path)).collect()
    assert len(rows) == 2000
    assert ranges.archive_entries(spark.createDataFrame([("/no/such/file",)], "path string")).first().error


def test_many_archives_in_one_pass(spark, tmp_path, monkeypatch):
    calls = []
    monkeypatch.setattr(archives, "segments", lambda *a, made=archives.segments: calls.append(1) or made(*a))
    monkeypatch.setattr(archives, "OPEN_FILES", 2)
    rows = [(i, "e%d" % i, (b"%d," % i) * (i % 5)) for i in range(-3, 40)]
    parts = spark.createDataFrame([(i, n, bytearray(b)) for i, n, b in rows], "o long, name string, data binary").repartition(3)
    assert archives.write_archives(parts, str(tmp_path), F.floor(F.col("o") / 10), ["o"], []) == 5 and calls == [1]
    got = {}
    for k in range(-1, 4):
        with zipfile.ZipFile(tmp_path / f"{k}.zip") as z:
            assert z.testzip() is None and z.namelist() == [n for i, n, _ in rows if i // 10 == k]
            got |= {n: z.read(n) for n in z.namelist()}
    assert got == {n: b for _, n, b in rows}
