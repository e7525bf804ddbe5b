"""WAV files as samples."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import CHUNK_SECONDS, OVERLAP_SECONDS, RATE
from ..functions.lazy import pandas_function
from .ranges import Ranged


class Layout(NamedTuple):
    """Where a recording's frames are in its file, and what they hold."""

    kind: int
    channels: int
    rate: int
    bits: int
    start: int
    frames: int

    @property
    def width(self) -> int:
        return self.bits // 8 * self.channels

    @property
    def samples(self) -> int:
        """Samples after resampling."""
        if self.rate == RATE or not self.frames:
            return self.frames
        return max(1, int(np.floor(self.frames * RATE / self.rate + 0.5)))


def layout(read: Callable[[int, int], bytes], size: int) -> Layout | None:
    """Layout of PCM (8, 16, 24, 32 bits) or float (32, 64) audio from ``read`` (start, length), a few bytes at a time; None of
    anything else. Audio data that ends early raises."""
    head = read(0, 12)
    if size < 12 or head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        return None
    form, body, at = None, None, 12
    while at + 8 <= size:
        head = read(at, 40)
        length, = struct.unpack_from("<I", head, 4)
        if head[:4] == b"fmt " and at + 24 <= size:
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", head, 8)
            if kind == 0xFFFE and length >= 40:
                kind, = struct.unpack_from("<H", head, 32)
            form = kind, channels, rate, bits
        elif head[:4] == b"data":
            body = at + 8, length
        at += 8 + length + length % 2
    if not form or not body or not form[1] or not form[2] or form[0] not in (1, 3):
        return None
    if body[0] + body[1] > size:
        raise ValueError("the audio data ends early")
    if form[3] not in ((32, 64) if form[0] == 3 else (8, 16, 24, 32)):
        raise ValueError(f"{form[3]} bits a sample")
    return Layout(*form, body[0], body[1] // (form[3] // 8 * form[1]))


def mono(raw: bytes, form: Layout) -> np.ndarray:
    """The mean of the channels of whole frames."""
    if form.kind == 3:
        samples = np.frombuffer(raw, {32: "<f4", 64: "<f8"}[form.bits]).astype(float)
    elif form.bits == 8:
        samples = (np.frombuffer(raw, np.uint8) - 128.0) / 128
    elif form.bits == 24:
        parts = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        value = parts[:, 0] | parts[:, 1] << 8 | parts[:, 2] << 16
        samples = np.where(value & 0x800000, value - 0x1000000, value) / 8388608
    else:
        samples = np.frombuffer(raw, f"<i{form.bits // 8}") / float(1 << (form.bits - 1))
    return samples.reshape(-1, form.channels).mean(axis=1).astype(np.float32)


def decode_wav(data: bytes | None) -> tuple[np.ndarray, int] | None:
    """Mono samples and rate of a whole file; None of what is no recording that can be read."""
    data = bytes(data or b"")
    form = layout(lambda at, n: data[at : at + n], len(data))
    return form and (mono(data[form.start : form.start + form.frames * form.width], form), form.rate)


def cut(read: Callable[[int, int], bytes], form: Layout, start: int, end: int) -> np.ndarray:
    """Samples ``start`` to ``end`` of the resampled recording, from the frames they need and no others."""
    if end <= start:
        return np.zeros(0, np.float32)
    if form.rate == RATE:
        return mono(read(form.start + start * form.width, (end - start) * form.width), form)
    at = np.arange(start, end) * (form.rate / RATE)
    low = np.minimum(at.astype(int), form.frames - 1)
    high = np.minimum(low + 1, form.frames - 1)
    first = int(low[0])
    found = mono(read(form.start + first * form.width, (int(high[-1]) + 1 - first) * form.width), form)
    return (found[low - first] + (found[high - first] - found[low - first]) * (at - low)).astype(np.float32)


def chunks(n: int, size: int = CHUNK_SECONDS * RATE, overlap: int = OVERLAP_SECONDS * RATE) -> Iterator[tuple[int, int, int]]:
    """(number, start, end) of windows over ``n`` samples that overlap, until one reaches the end."""
    count = 1 if n <= size else 1 + -(-(n - size) // (size - overlap))
    for k in range(count):
        yield k, k * (size - overlap), min(k * (size - overlap) + size, n)


def resample(samples: np.ndarray, rate: int, to: int = RATE) -> np.ndarray:
    """Linear interpolation with the next sample, the last one held; none stay none."""
    if rate == to or not len(samples):
        return samples
    n = max(1, int(np.floor(len(samples) * to / rate + 0.5)))
    at = np.arange(n) * (rate / to)
    low = np.minimum(at.astype(int), len(samples) - 1)
    high = np.minimum(low + 1, len(samples) - 1)
    return (samples[low] + (samples[high] - samples[low]) * (at - low)).astype(np.float32)


@pandas_function("struct<rate:int,samples:array<float>,error:string>")
def wav_samples(contents: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """16 kHz samples of each WAV file, or an error; null for null; never fails a task."""
    for series in contents:
        rows = []
        for data in series:
            if data is None:
                rows.append((None, None, None))
                continue
            try:
                found = decode_wav(data)
                rows.append((RATE, resample(*found), None) if found else (None, None, "not a WAV file that can be decoded"))
            except (ValueError, KeyError, struct.error) as e:
                rows.append((None, None, str(e)))
        yield pd.DataFrame(rows, columns=["rate", "samples", "error"])


CHUNKS = "path string, rate int, n long, chunk_no int, start long, end long, error string"


def chunks_of(files: DataFrame, path_col: str = "path", size: int = CHUNK_SECONDS * RATE, overlap: int = OVERLAP_SECONDS * RATE) -> DataFrame:
    """The chunks of each recording at ``path``, from its headers alone: rate (the file's), n (samples at 16 kHz), chunk_no, start,
    end. What is no recording, is cut short or cannot be opened has one row, with ``error``; an empty one has no chunks but
    a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    with Ranged(path) as file:
                        form = layout(file.at, file.size)
                    if form is None:
                        rows = [(path, None, None, None, None, None, "not a WAV file that can be decoded")]
                    elif not form.samples:
                        rows = [(path, form.rate, 0, None, None, None, None)]
                    else:
                        rows = [(path, form.rate, form.samples, *c, None) for c in chunks(form.samples, size, overlap)]
                except (OSError, ValueError, struct.error) as e:
                    rows = [(path, None, None, None, None, None, str(e)[:200])]
                kinds = (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string())
                for i in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[i : i + 10_000]], t) for k, t in enumerate(kinds)], names=["path", "rate", "n", "chunk_no", "start", "end", "error"])

    return files.select(F.col(path_col).cast("string")).mapInArrow(run, CHUNKS)


def samples_of(found: DataFrame) -> DataFrame:
    """``chunks_of`` with samples: each row reads its own range of bytes, and a batch is one chunk. Deal the rows out first
    where a recording is long: its chunks are then many tasks' work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row, samples, error = batch.slice(i, 1).to_pylist()[0], None, None
                if row["chunk_no"] is not None:
                    try:
                        with Ranged(row["path"]) as file:
                            samples = cut(file.at, layout(file.at, file.size), row["start"], row["end"])
                    except (OSError, ValueError, struct.error) as e:
                        error = str(e)[:200]
                columns = [pa.array([row["error"] or error]).cast(pa.string()) if n == "error" else c for n, c in zip(batch.schema.names, batch.slice(i, 1).columns, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([samples], pa.list_(pa.float32()))], names=[*batch.schema.names, "samples"])

    return found.mapInArrow(run, f"{CHUNKS}, samples array<float>")
