"""WAV files as a Spark data source: headers alone for durations, or decoded samples; and a writer of 16-bit files.

The source lists the files under a path (a folder or one file) through ``pyarrow.fs``, which opens local folders and the common object
and cluster stores, and deals them to partitions by bytes to be read. Without samples, a file costs the few bytes of its chunk headers, whatever its
length. With samples, channels are averaged, the rate is changed by a polyphase filter, and the greatest magnitude becomes one.

Defined results: a file that is not a readable WAV has an ``error``, no samples and a duration of 0. A data chunk that claims more than the
file holds ends with the file. Silence, with no magnitude over 1e-8, is not scaled.
"""

from __future__ import annotations

import math
import re
import struct
import uuid
from collections.abc import Callable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from plexure.operators import frames

#: Fixed values of the format: codes of sample kinds, and the code that sends one to the extension for them.
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
SAMPLES = {(PCM, 8): "u1", (PCM, 16): "<i2", (PCM, 32): "<i4", (FLOAT, 32): "<f4", (FLOAT, 64): "<f8"}
HEADER_BYTES, PART_BYTES, BATCH_BYTES = 1 << 12, 64 << 20, 8 << 20
SCHEMA = "path string, sample_rate int, channels int, bits int, frames long, duration double, error string, samples array<float>"


class Header(NamedTuple):
    rate: int
    channels: int
    bits: int
    kind: int
    start: int
    frames: int

    @property
    def duration(self) -> float:
        return self.frames / self.rate if self.rate else 0.0


def read_header(read: Callable[[int, int], bytes], size: int) -> Header:
    """The header of a file of ``size`` bytes, of which ``read(at, n)`` gives some. Chunks other than the format's and the data's are skipped unread."""
    first = read(0, 12)
    if len(first) < 12 or first[:4] not in (b"RIFF", b"RF64") or first[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, found, wide = 12, None, None
    while at + 8 <= size:
        name, length = struct.unpack("<4sI", read(at, 8))
        if name == b"ds64":
            wide = struct.unpack("<QQ", read(at + 8, 16))[1]
        elif name == b"fmt ":
            body = read(at + 8, min(length, 40))
            kind, channels, rate, _, block, bits = struct.unpack("<HHIIHH", body[:16])
            if kind == EXTENSIBLE and len(body) >= 26:
                kind = struct.unpack("<H", body[24:26])[0]
            found = kind, channels, rate, block, bits
        elif name == b"data":
            if found is None:
                raise ValueError("data before its format")
            kind, channels, rate, block, bits = found
            if wide is not None and length == 0xFFFFFFFF:
                length = wide
            held = min(length, size - at - 8)
            return Header(rate, channels, bits, kind, at + 8, held // max(block, 1))
        at += 8 + length + length % 2
    raise ValueError("no data")


def decode(data: bytes, header: Header) -> np.ndarray:
    """Frames by channels, whole numbers scaled to [-1, 1)."""
    frames, channels = header.frames, max(header.channels, 1)
    if header.kind == PCM and header.bits == 24:
        raw = np.frombuffer(data, np.uint8, frames * channels * 3).reshape(-1, 3)
        wide = np.zeros((len(raw), 4), np.uint8)
        wide[:, 1:] = raw
        x = wide.view("<i4").ravel() / 2.0**31
    else:
        code = SAMPLES.get((header.kind, header.bits))
        if code is None:
            raise ValueError(f"samples of kind {header.kind} with {header.bits} bits")
        raw = np.frombuffer(data, code, frames * channels)
        x = (raw - 128.0) / 128.0 if code == "u1" else raw.astype(float) / (1.0 if header.kind == FLOAT else 2.0 ** (header.bits - 1))
    return x.reshape(frames, channels)


@cache
def _filters(source: int, target: int, zeros: int = 6, rolloff: float = 0.99) -> tuple[np.ndarray, int]:
    """For each of ``target`` output phases the taps of a windowed sinc over the inputs, and how far they reach back."""
    cutoff = min(source, target) * rolloff
    reach = math.ceil(zeros * source / cutoff)
    inputs, phases = np.arange(-reach, reach + source) / source, np.arange(target) / target
    t = np.clip((inputs[None, :] - phases[:, None]) * cutoff, -zeros, zeros)
    return np.sinc(t) * np.cos(np.pi * t / (2 * zeros)) ** 2 * (cutoff / source), reach


def resampled(x: np.ndarray, source: int, target: int) -> np.ndarray:
    """A waveform at another rate, by polyphase filters: ceil(len * target / source) samples."""
    common = math.gcd(source, target)
    source, target = source // common, target // common
    if source == target or not len(x):
        return x
    taps, reach = _filters(source, target)
    padded = np.concatenate([np.zeros(reach), x, np.zeros(reach + source)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, taps.shape[1])[::source]
    step = max(1, (4 << 20) // taps.shape[1])
    parts = [windows[at : at + step] @ taps.T for at in range(0, len(windows), step)]
    return np.concatenate(parts).ravel()[: math.ceil(len(x) * target / source)]


def example(data: bytes, header: Header, rate: int | None, peak: bool) -> np.ndarray:
    """The waveform of decoded data: channels averaged, at ``rate`` if given, scaled to a greatest magnitude of one if asked."""
    x = decode(data, header).mean(axis=1) if header.channels > 1 else decode(data, header).ravel()
    if rate:
        x = resampled(x, header.rate, rate)
    top = np.abs(x).max(initial=0.0)
    return x / top if peak and top > 1e-8 else x


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    path = re.sub(r"^file:/+", "/", path)
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]) -> None:
        self.files = files


class WavReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.samples = options.get("samples", "true") == "true"
        self.rate = int(options.get("rate", 0)) or None
        self.peak = options.get("normalize", "true") == "true"
        self.kind = np.float64 if options.get("wide", "false") == "true" else np.float32

    def partitions(self) -> list[Files]:
        store, path = _opened(self.path)
        info = store.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.extension.lower() == "wav")
        out: list[list[tuple[str, int]]] = []
        held = 0
        for name, size in files:
            cost = (size if self.samples else 0) + HEADER_BYTES
            if not out or held + cost > PART_BYTES:
                out.append([])
                held = 0
            out[-1].append((name, size))
            held += cost
        return [Files(f) for f in out] or [Files([])]

    def _row(self, store: fs.FileSystem, path: str, size: int) -> tuple:
        try:
            with store.open_input_file(path) as f:
                head = f.read_at(min(size, HEADER_BYTES), 0)
                get = lambda at, n: head[at : at + n] if at + n <= len(head) else f.read_at(min(n, max(size - at, 0)), at)
                header = read_header(get, size)
                x = None
                if self.samples:
                    block = header.bits // 8 * header.channels
                    x = example(f.read_at(header.frames * block, header.start), header, self.rate, self.peak).astype(self.kind)
            return path, header.rate, header.channels, header.bits, header.frames, header.duration, None, x
        except Exception as e:
            # What is wrong with one file is told in its row; the others are read.
            return path, None, None, None, None, 0.0, str(e) or type(e).__name__, None

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = _opened(self.path)
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.string(), pa.list_(pa.from_numpy_dtype(self.kind))]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        rows, held = [], 0
        for path, size in partition.files:
            rows.append(self._row(store, path, size))
            held += HEADER_BYTES + (rows[-1][-1].nbytes if rows[-1][-1] is not None else 0)
            if held > BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def encoded(x: np.ndarray, rate: int, channels: int, bits: int = 16) -> bytes:
    """A file of interleaved samples: of 16 bits, where those beyond [-1, 1) are held at the bounds, or of 32 or 64 bits as they are, in floating point."""
    if bits == 16:
        kind, data = PCM, np.clip(np.round(np.asarray(x, float) * 32768), -32768, 32767).astype("<i2").tobytes()
    else:
        kind, data = FLOAT, np.asarray(x, SAMPLES[FLOAT, bits]).tobytes()
    block = channels * bits // 8
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, kind, channels, rate, rate * block, block, bits)
    body = b"WAVE" + form + struct.pack("<4sI", b"data", len(data)) + data
    return struct.pack("<4sI", b"RIFF", len(body)) + body


class WavWriter(DataSourceArrowWriter):
    """Writes rows (name, sample_rate, channels, samples) to name.wav. A file is written aside and moved, so that it is whole or not there."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.bits = int(options.get("bits", 16))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = _opened(self.path)
        for batch in iterator:
            for r in batch.to_pylist():
                folder, _, leaf = f"{root}/{r['name']}".rpartition("/")
                aside = f"{folder}/.{leaf}-{uuid.uuid4().hex}"
                store.create_dir(folder)
                with store.open_output_stream(aside) as out:
                    out.write(encoded(np.array(r["samples"], float), r["sample_rate"], r["channels"], self.bits))
                store.move(aside, f"{root}/{r['name']}.wav")
        return WriterCommitMessage()


class WavSource(DataSource):
    """Options: path; samples (true): decode them; rate: change to it; normalize (true): scale to a greatest magnitude of one; wide (false): samples as doubles.

    For writing: bits (16; 32 and 64 are floating point).
    """

    @classmethod
    def name(cls) -> str:
        return "plexure_wav"

    def schema(self) -> str:
        return SCHEMA.replace("array<float>", "array<double>") if self.options.get("wide", "false") == "true" else SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WavReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WavWriter(dict(self.options))


def read_audio(spark: SparkSession, path: str, rate: int | None = None, normalize: bool = True, wide: bool = False) -> DataFrame:
    """Examples: path, sample_rate (that of the samples), channels, duration, error and samples of each file."""
    spark.dataSource.register(WavSource)
    df = spark.read.format("plexure_wav").option("normalize", str(normalize).lower()).option("rate", rate or 0).option("wide", str(wide).lower()).load(path)
    return df.withColumn("sample_rate", F.when(F.col("samples").isNotNull() & bool(rate), F.lit(rate or 0)).otherwise(F.col("sample_rate")))


def durations(spark: SparkSession, path: str) -> DataFrame:
    """path, frames, sample_rate and duration in seconds of each file, from headers alone; 0 for files that cannot be read."""
    spark.dataSource.register(WavSource)
    return spark.read.format("plexure_wav").option("samples", "false").load(path).select("path", "frames", "sample_rate", "duration", "error")


def write_audio(df: DataFrame, path: str, bits: int = 16) -> None:
    """Rows (name, sample_rate, channels, samples) as files under a folder, of 16 bits or, where samples leave [-1, 1) or are finer, of 32 or 64."""
    df.sparkSession.dataSource.register(WavSource)
    columns = [F.col("name").cast("string"), F.col("sample_rate").cast("int"), F.col("channels").cast("int"), F.col("samples").cast("array<double>")]
    df.select(*columns).write.format("plexure_wav").option("bits", bits).mode("append").save(path)


def path_features(spark: SparkSession, path: str, rate: int, encode: frames.Encode, budget: int = 1 << 22) -> DataFrame:
    """id (the file's path), frame and features of all files under a path: their samples at ``rate``, over their greatest magnitude, encoded in batches of like lengths."""
    rows = read_audio(spark, path, rate, normalize=False).filter(F.size("samples") > 0)
    top = F.array_max(F.transform("samples", F.abs)).cast("double") + 1e-8
    scaled = rows.select("path", F.transform("samples", lambda x: x.cast("double") / top).alias("samples"))
    return frames.frame_features(frames.in_batches(scaled, "path", "samples", budget), encode)
