import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import audio, export, history, image, ocr, recognition
from millrace.plans import convert as plan
from millrace.plans import samples
from millrace.sources.files import in_order


def test_lines_between_two_models():
    engine = samples.models()
    assert [x.text for x in engine(samples.bmp(samples.bars(3, 2)), "en")] == ["xx", "xxx", "xxxx"]
    assert engine(samples.bmp(samples.bars(0, 0)), "en") == []
    # no letters of a language: nothing is made up
    assert engine(samples.bmp(samples.bars(1, 2)), "hi") == []
    with pytest.raises(ValueError):
        engine(b"\xff\xd8\xff", "en")


def test_preprocessing_that_fails_leaves_the_image(monkeypatch):
    monkeypatch.setattr(image, "preprocess", lambda img: 1 / 0)
    assert [x.text for x in samples.models()(samples.bmp(samples.bars(1, 3)), "en")] == ["xxx"]


def test_wide_lines_are_cut_and_joined():
    img = np.full((60, 1200, 3), 255, np.uint8)
    for x in [*range(20, 400, 20), *range(600, 1100, 20)]:
        img[20:32, x : x + 10] = 0
    line = samples.models().line(img, "en")
    assert line.text == "x" * 19 + " " + "x" * 25 and line.confidence > 0.9


def test_crop_and_dims():
    assert ocr.crop(np.arange(12).reshape(3, 4), (1, 0, 3, 2)).tolist() == [[1, 2], [5, 6]]
    assert ocr.detector_dims(1000, 500) == (960, 480) and ocr.recognizer_width(1000, 10) == 480


def test_confidences_by_the_scale_of_their_engine():
    engines = recognition.Engines(lambda *_: [recognition.Line("a", 0.9), recognition.Line("b", 1.0)], samples.second)
    assert recognition.run_ocr(b"x", "en", engines)[2:4] == (0.95, "rapidocr")
    assert recognition.run_ocr(b"x", "en", recognition.Engines(lambda *_: [], samples.second))[2:4] == (0.7, "tesseract")


def test_one_file_is_many_tasks_work(spark):
    data = samples.wav(16_000 * 240, 16_000, 8)
    files = spark.createDataFrame([("a.wav", "a.wav", len(data), bytearray(data)), ("b.pdf", "b.pdf", 1, bytearray(samples.scanned_pdf()))], "path string, name string, length long, content binary")
    from millrace.sources.classify import classified

    items = plan._items(classified(files).withColumn("id", F.col("path")), samples.engines())
    found = plan._recognized(items, samples.engines(), F.lit("en")).withColumn("at", F.spark_partition_id())
    rows = found.where("part IS NOT NULL AND id = 'a.wav'").select("part.no", "part.text", "at").collect()
    assert [r.no for r in sorted(rows)] == list(range(9)) and len({r["at"] for r in rows}) > 1
    assert found.where("part IS NOT NULL AND id = 'b.pdf'").select("part.text").first()[0] == "xxx\nxxxx"


def test_history_recognizes_once_and_writes_what_changed(spark, tmp_path):
    calls = tmp_path / "calls"

    def read(image, language):
        with calls.open("a") as f:
            f.write("x")
        return [recognition.Line("found", 0.9)]

    files = spark.createDataFrame([(f"{k}.bmp", f"{k}.bmp", 0, bytearray(samples.bmp(samples.bars(1, k)))) for k in range(3)], "path string, name string, length long, content binary")
    results = plan.convert(files, recognition.Engines(ocr=read))
    store = history.Store(spark, str(tmp_path / "h"))
    store.add(results)
    assert calls.read_text() == "xxx" and store.read().count() == 3
    other = history.Store(spark, str(tmp_path / "h"))
    other.delete(store.read().where("file_name = '1.bmp'").select("id"))
    assert sorted(r.file_name for r in store.read().collect()) == ["0.bmp", "2.bmp"]
    written = spark.read.parquet(f"{tmp_path}/h/data/{store.log.runs()[-1].data}")
    assert written.count() == 1
    for _ in range(9):
        store.delete(spark.createDataFrame([("nothing",)], "id string"))
    assert store.read().count() == 2 and len(store.log.runs()) < 8


def test_order_and_last(spark):
    rows = spark.createDataFrame([("b", 2), ("a", 1), ("c", 3)], "name string, seq int").withColumn("path", F.col("name"))
    assert [r.name for r in in_order(rows).orderBy("ordinal").collect()] == ["a", "b", "c"]
    assert [r.name for r in history.session(rows, "seq").collect()] == ["c", "b", "a"]
    got = spark.range(1).select(history.last(F.array(*map(F.lit, range(6))), 4).alias("a"), history.last(F.array(F.lit(1)), 4).alias("b")).first()
    assert got.a == [2, 3, 4, 5] and got.b == [1]


def test_names_that_many_rows_share(spark):
    rows = spark.createDataFrame([(k, "pasted.md" if k % 3 else f"x{k}.md") for k in range(500)] + [(900, None)], "k int, name string").repartition(7)
    got = {r.k: r.entry for r in export.unique_names(rows, "name", "k").collect()}
    shared = [k for k in range(500) if k % 3]
    assert [got[k] for k in shared] == ["pasted.md", *(f"pasted ({n}).md" for n in range(1, len(shared)))] and got[3] == "x3.md" and len(got) == 501


def test_event_windows(spark):
    rows = spark.createDataFrame([(0,), (27,), (29,), (60,)], "s int").withColumn("ts", F.timestamp_seconds("s"))
    got = sorted((int(r.start.timestamp()), r.n) for r in audio.event_windows(rows).collect())
    assert got == [(-28, 1), (0, 3), (28, 1), (56, 1)]


def test_combined_export(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, "b.txt", " two ", "ok"), (1, 1, "a.txt", "one", "ok"), (1, 3, "c", "x", "error"), (2, 1, "d", "y", "error")], "g int, o int, name string, md string, status string")
    made = rows.groupBy("g").agg(export.combined_markdown(F.col("o"), F.col("name"), F.col("md"), F.col("status")).alias("text"))
    export.write_text(made.where("g = 1"), str(tmp_path / "out"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))) == "## a.txt\n\n\n\none\n\n## b.txt\n\n\n\ntwo\n\n"
    assert made.where("g = 2").first().text == ""


def test_zip_contents_of_damaged_entries(spark):
    from millrace.sources import archive

    data = bytearray(archive.build_zip([("a", b"one"), ("b", b"two")]))
    archive.register(spark)
    data[0] ^= 1  # the first entry's own header
    spark.createDataFrame([(data,), (bytearray(b"no"),)], "content binary").createOrReplaceTempView("damaged")
    got = spark.sql("SELECT e.name, e.content FROM damaged d, LATERAL zip_contents(d.content) e").collect()
    assert [(r.name, r.content and bytes(r.content)) for r in got] == [("a", None), ("b", b"two")]
