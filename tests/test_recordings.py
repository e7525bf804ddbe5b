import numpy as np
import pytest
from millrace.operators.recognition import Engines, drawn
from millrace.plans import samples
from millrace.sources import audio, documents
from pyspark.sql import functions as F

from .test_binary import wav


@pytest.mark.parametrize("rate", [8000, 16_000, 22_050, 44_100])
@pytest.mark.parametrize("bits,kind,channels", [(8, 1, 1), (16, 1, 2), (24, 1, 1), (32, 1, 1), (32, 3, 2)])
def test_chunks_are_the_slices_of_the_whole(rate, bits, kind, channels):
    values = [float(x) for x in np.random.default_rng(1).uniform(-0.9, 0.9, 3000)]
    data = wav(values, channels=channels, rate=rate, bits=bits, kind=kind)
    whole = audio.resample(*audio.decode_wav(data))
    asked = []
    read = lambda at, n: (asked.append(n), data[at : at + n])[1]
    form = audio.layout(read, len(data))
    assert form.samples == len(whole) and max(asked) <= 40
    for _, start, end in audio.chunks(form.samples, 500, 40):
        assert np.array_equal(audio.cut(read, form, start, end), whole[start:end])
    assert max(asked) <= (500 * rate / 16_000 + 3) * form.width


def test_ends_of_chunks():
    assert [*audio.chunks(480_000)] == [(0, 0, 480_000)]
    assert [*audio.chunks(480_001)] == [(0, 0, 480_000), (1, 448_000, 480_001)]
    assert len([*audio.chunks(1_440_000)]) == 4


def test_recordings_by_ranges(spark, tmp_path):
    values = np.sin(np.arange(50_000) / 7) * 0.8
    (tmp_path / "a.wav").write_bytes(wav([*map(float, values)], rate=22_050))
    (tmp_path / "b.wav").write_bytes(b"no recording")
    (tmp_path / "c.wav").write_bytes(wav([], rate=8000))
    (tmp_path / "d.wav").write_bytes(wav([0.1] * 100)[:-9])
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path")
    found = audio.chunks_of(files, size=9000, overlap=1000)
    rows = audio.samples_of(found.repartition(4, "path", "chunk_no")).orderBy("path", "chunk_no").collect()
    whole = audio.resample(*audio.decode_wav((tmp_path / "a.wav").read_bytes()))
    own = [r for r in rows if r.path.endswith("a.wav")]
    assert len(own) == 5 and all(np.array_equal(np.array(r.samples, np.float32), whole[r.start : r.end]) for r in own)
    others = {r.path[-5]: r for r in rows if not r.path.endswith("a.wav")}
    assert others["b"].error == "not a WAV file that can be decoded" and others["d"].error == "the audio data ends early"
    assert others["c"].n == 0 and others["c"].samples is None and others["c"].error is None


def test_a_document_is_parsed_once_for_all_its_pages(monkeypatch):
    parsed, own = [], documents.Pdf

    class Counted(own):
        def __init__(self, data):
            parsed.append(1)
            super().__init__(data)

    monkeypatch.setattr(documents, "Pdf", Counted)
    found = [*drawn(samples.scanned_pdf(), [1, 2, 2, 9], Engines())]
    assert len(parsed) == 1 and [p for p, *_ in found] == [1, 2, 2, 9] and found[1][1][:4] == b"\x89PNG"
    assert [*drawn(b"trailer << /Encrypt 5 0 R >> startxref", [1], Engines())] == [(1, None, "This PDF is password-protected.")]


def test_no_row_or_batch_holds_two_chunks(spark):
    from millrace.plans import convert
    from millrace.sources.classify import classified

    data = samples.wav(16_000 * 100, 16_000, 8)
    files = spark.createDataFrame([("a.wav", "a.wav", len(data), bytearray(data))], "path string, name string, length long, content binary")
    items = convert._items(classified(files).withColumn("id", F.col("path")), samples.engines())
    found = items.select("item.no", F.size("item.samples").alias("n")).collect()
    assert sorted((r.no, r.n) for r in found if r.no >= 0) == [(0, 480_000), (1, 480_000), (2, 480_000), (3, 256_000)]
    assert [r.n for r in found if r.no < 0] in ([-1], [None])
