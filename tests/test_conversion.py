import pytest
from pyspark.sql import functions as F

from millrace.operators import export, history
from millrace.operators.recognition import EngineError, Engines, Line, dictionary, model_bytes, run_ocr
from millrace.plans.convert import Options, convert
from millrace.sources import archive
from millrace.sources.files import empty_files, pasted_images, scan, too_large, within_limit
from millrace.streaming import jobs

from .test_binary import packed, page, pdf, png, wav


def see(data, language):
    return [Line(f"seen {len(data) > 0} {language}", 0.9)]


def unsure(data, language):
    return [Line("unsure", 0.2)]


def second(data, language):
    return [Line("second", 80.0)]


def broken(data, language):
    raise EngineError("MODEL_DOWNLOAD", "none")


def hear(samples, language):
    return "we are going to" if len(samples) == 480_000 else "going to the end"


def put(folder, files):
    for name, data in files.items():
        (folder / name).write_bytes(data)
    return str(folder)


DOC = '<w:document xmlns:w="urn:w"><w:body><w:p><w:r><w:t>Hello office</w:t></w:r></w:p></w:body></w:document>'


def test_convert_all_kinds(spark, tmp_path):
    import numpy as np

    files = {
        "a.txt": b"hello", "b.docx": packed({"word/document.xml": DOC}), "c.pdf": pdf(b"BT (text) Tj ET", b"q Q"), "d.png": png(np.repeat(page()[..., None], 3, 2)),
        "e.wav": wav([0.1] * 500_000), "f.bin": b"\x01\x02\x03", "g.docx": packed({"word/document.xml": "<broken"}), "h.big": b"x" * 9_000_000, "i.txt": b"", "j.csv": b"a,b\n1,2",
    }
    arrived = scan(spark, put(tmp_path, files)).unionByName(empty_files(spark, str(tmp_path)))
    got = {r.file_name: r for r in convert(arrived, Engines(see, broken, hear), Options(max_file_size=8_000_000)).collect()}
    assert got.keys() == files.keys()
    assert got["a.txt"].markdown == "```text\nhello\n```" and got["a.txt"].metadata.engine == "text"
    assert got["b.docx"].markdown == "Hello office" and got["b.docx"].metadata.engine == "anydoc"
    assert got["c.pdf"].metadata.engine == "pdf-inspector+ocr" and got["c.pdf"].markdown.index("text") < got["c.pdf"].markdown.index("seen True en")
    assert got["d.png"].markdown == "seen True en" and got["d.png"].metadata.ocr.mean_confidence == pytest.approx(0.9)
    assert got["e.wav"].markdown == "we are going to the end"
    assert {n: got[n].error.code for n in ("f.bin", "g.docx", "h.big", "i.txt")} == {"f.bin": "unknown", "g.docx": "internal", "h.big": "too-large", "i.txt": "empty"}
    assert "8.6 MB" in got["h.big"].error.message and got["j.csv"].markdown.startswith("| a | b |")
    again = {r.file_name: r.id for r in convert(arrived, Engines(see, broken, hear), Options(max_file_size=8_000_000)).collect()}
    assert again == {n: r.id for n, r in got.items()}


def test_without_engines_media_are_error_rows(spark, tmp_path):
    import numpy as np

    got = {r.file_name: r for r in convert(scan(spark, put(tmp_path, {"a.png": png(np.zeros((9, 9, 3), np.uint8)), "b.wav": wav([0.0] * 10), "c.mp3": b"ID3xxxx"}))).collect()}
    assert {n: r.error.code for n, r in got.items()} == {"a.png": "MODEL_DOWNLOAD", "b.wav": "MODEL_DOWNLOAD", "c.mp3": "internal"}


def test_ocr_policy():
    assert run_ocr(b"x", "en", Engines(see, broken))[3] == "rapidocr"
    assert run_ocr(b"x", "en", Engines(unsure, second))[2:4] == (0.8, "tesseract")
    assert run_ocr(b"x", "en", Engines(broken, second))[0] == "second"
    assert run_ocr(b"x", "en", Engines(lambda *_: [], broken))[4] == "MODEL_DOWNLOAD"


def test_size_limit_reaches_the_scan(spark, tmp_path):
    files = scan(spark, put(tmp_path, {"a": b"123", "b": b"1234567"}))
    assert [r.name for r in within_limit(files, 5).collect()] == ["a"]
    plan = within_limit(files, 5)._jdf.queryExecution().toString()
    assert "LessThanOrEqual(length,5)" in plan
    assert "content" not in too_large(files, 5)._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def test_zip_entries_in_sql(spark, tmp_path):
    archive.register(spark)
    scan(spark, put(tmp_path, {"a.zip": archive.build_zip([("x.md", b"1"), ("y.md", b"22")]), "b.txt": b"no"})).createOrReplaceTempView("zip_files")
    got = spark.sql("SELECT e.name, e.size FROM zip_files f, LATERAL zip_entries(f.content) e").collect()
    assert sorted(map(tuple, got)) == [("x.md", 1), ("y.md", 2)]


def test_archives(spark):
    rows = spark.createDataFrame([(1, 2, "a.txt", "second", "ok"), (1, 1, "a.pdf", "first", "ok"), (1, 3, "b", "bad", "error"), (2, 1, "c", "x", "ok")], "g int, o int, file_name string, markdown string, status string")
    got = {r.group: r.zip for r in export.archives(rows, "g", "o").collect()}
    entries = archive.read_entries(bytes(got["1"]))
    assert [(e.name, archive.read_stored(bytes(got["1"]), e)) for e in entries] == [("a.md", b"first"), ("a (1).md", b"second")] and len(got) == 2


def test_history(spark, tmp_path):
    (tmp_path / "in").mkdir()
    results = convert(scan(spark, put(tmp_path / "in", {"a.txt": b"alpha", "b.txt": b"beta", "c.bin": b"\x01\x02"})))
    store = history.Store(spark, str(tmp_path / "history"))
    assert store.read().count() == 0
    store.add(results)
    store.add(results)
    rows = store.read()
    assert sorted(r.file_name for r in rows.collect()) == ["a.txt", "b.txt"]
    assert [r.file_name for r in history.search(rows, " ALPHA ").collect()] == ["a.txt"]
    ids = rows.where("file_name = 'a.txt'").select("id")
    edits = ids.withColumn("text", F.lit("  edited  "))
    assert history.edited(rows, edits).where("file_name = 'a.txt'").first().markdown == "edited"
    store.delete(ids)
    assert [r.file_name for r in history.listed(store.read()).collect()] == ["b.txt"]
    assert history.newest(store.read(), 1).count() == 1
    store.clear()
    assert store.read().count() == 0


def test_arrivals_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    store = history.Store(spark, str(tmp_path / "history"))
    for files in ({"a.txt": b"one"}, {"b.txt": b"two"}):
        put(tmp_path / "in", files)
        jobs.convert_arrivals(spark, str(tmp_path / "in"), store, str(tmp_path / "check")).awaitTermination()
    assert sorted(r.file_name for r in store.read().collect()) == ["a.txt", "b.txt"]


def test_job_events(spark):
    rows = [("a", "2026-01-01 00:00:00", 1), ("a", "2026-01-01 00:00:59", 2), ("a", "2026-01-01 00:02:00", 3), ("b", "2026-01-01 00:00:00", 4)]
    events = spark.createDataFrame(rows, "id string, ts string, percent int").withColumn("ts", F.col("ts").cast("timestamp"))
    spans = sorted((r.id, str(r.times_out), r.n) for r in jobs.active_spans(events).collect())
    assert spans == [("a", "2026-01-01 00:01:59", 2), ("a", "2026-01-01 00:03:00", 1), ("b", "2026-01-01 00:01:00", 1)]
    assert {r.id: r.percent for r in jobs.latest_progress(events).collect()} == {"a": 3, "b": 4}
    assert jobs.known_jobs(events, spark.createDataFrame([("b",)], "id string")).count() == 1


def test_pasted_images(spark):
    items = spark.createDataFrame([("file", "image/png"), ("string", "image/png"), ("file", "text/plain")], "kind string, mime string")
    assert pasted_images(items).count() == 1


def test_model_files(spark, tmp_path):
    put(tmp_path, {"dict.txt": "\ufeffa\r\nb\nç".encode(), "m.onnx": b"weights"})
    assert dictionary(spark, str(tmp_path / "dict.txt")) == ["a", "b", "ç"]
    assert model_bytes(spark, str(tmp_path), "m.onnx") == b"weights"
    with pytest.raises(EngineError):
        model_bytes(spark, str(tmp_path), "none.onnx")
