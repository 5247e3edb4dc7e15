"""The audio source on files that the tests write; batches of bounded padding; pooled token vectors."""

from __future__ import annotations

import math
import struct
import wave

import numpy as np
import pytest

from plexure.operators import frames as O
from plexure.sources import audio


def riff(kind, bits, channels, rate, data, extra=b"", form=16, rf64=False):
    fmt = struct.pack("<HHIIHH", 0xFFFE if form == 40 else kind, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    fmt += struct.pack("<HHIH14s", 22, bits, 0, kind, b"\0" * 14) if form == 40 else b""
    size = 0xFFFFFFFF if rf64 else len(data)
    wide = b"ds64" + struct.pack("<IQQQI", 28, 0, len(data), 0, 0) if rf64 else b""
    body = b"WAVE" + wide + extra + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", size) + data
    return (b"RF64" if rf64 else b"RIFF") + struct.pack("<I", len(body) & 0xFFFFFFFF) + body


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("wav")
    (root / "sub").mkdir()
    t = np.arange(4000) / 16000
    tone = np.sin(2 * np.pi * 440 * t)
    with wave.open(str(root / "tone.wav"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(16000)
        w.writeframes(np.stack([tone * 16000, tone * 8000], axis=1).astype("<i2").tobytes())
    (root / "sub" / "u8.WAV").write_bytes(riff(1, 8, 1, 4000, bytes([0, 128, 255])))
    x24 = b"".join(int(v).to_bytes(3, "little", signed=True) for v in (-(1 << 23), 0, 1 << 22))
    (root / "s24.wav").write_bytes(riff(1, 24, 1, 8000, x24, extra=b"LIST" + struct.pack("<I", 5) + b"12345\0", form=40))
    (root / "f32.wav").write_bytes(riff(3, 32, 1, 8000, np.array([0.25, -0.5], "<f4").tobytes(), rf64=True))
    (root / "cut.wav").write_bytes(riff(1, 16, 1, 8000, b"\0\1" * 100)[:-100])
    (root / "bad.wav").write_bytes(b"no audio at all")
    (root / "empty.wav").write_bytes(b"")
    (root / "other.txt").write_text("skipped")
    return root


def test_samples_of_all_kinds(spark, folder):
    got = {r.path.rsplit("/", 1)[-1]: r for r in audio.read_audio(spark, str(folder)).collect()}
    assert set(got) == {"tone.wav", "u8.WAV", "s24.wav", "f32.wav", "cut.wav", "bad.wav", "empty.wav"}
    assert got["u8.WAV"].samples == pytest.approx([-1, 0, 127 / 128]) and got["s24.wav"].samples == pytest.approx([-1, 0, 0.5])
    assert got["f32.wav"].samples == pytest.approx([0.5, -1]) and got["f32.wav"].frames == 2
    assert got["cut.wav"].frames == 50 and max(np.abs(got["tone.wav"].samples)) == pytest.approx(1)
    assert got["bad.wav"].error and got["bad.wav"].samples is None and got["empty.wav"].duration == 0
    one = audio.read_audio(spark, f"file://{folder}/tone.wav", rate=8000, normalize=False).first()
    want = np.sin(2 * np.pi * 440 * np.arange(2000) / 8000) * 12000 / 32768
    assert one.sample_rate == 8000 and len(one.samples) == 2000
    assert np.abs(np.array(one.samples) - want)[30:-30].max() < 1e-3


def test_durations_read_headers_only(spark, folder):
    got = {r.path.rsplit("/", 1)[-1]: r for r in audio.durations(spark, str(folder)).collect()}
    assert got["tone.wav"].duration == 0.25 and got["u8.WAV"].duration == 3 / 4000 and got["bad.wav"].duration == 0
    asked, data = [], riff(1, 16, 1, 8000, b"\0" * 2_000_000, extra=b"junk" + struct.pack("<I", 1_000_000) + b"\0" * 1_000_000)

    def read(at, n):
        asked.append(n)
        return data[at : at + n]

    assert audio.read_header(read, len(data)).frames == 1_000_000 and sum(asked) < 200


def test_resampling_by_definition():
    rng = np.random.default_rng(1)
    x = rng.normal(size=97)
    for source, target in ((3, 2), (2, 3), (441, 160), (16000, 8000), (5, 5)):
        got = audio.resampled(x, source, target)
        g = math.gcd(source, target)
        s, t = source // g, target // g
        assert len(got) == math.ceil(97 * t / s)
        if s == t:
            continue
        cut = min(s, t) * 0.99
        for k in range(0, len(got), 7):
            when = (np.arange(97) / s - k / t) * cut
            weight = np.sinc(when) * np.where(np.abs(when) < 6, np.cos(np.pi * when / 12) ** 2, 0) * cut / s
            assert got[k] == pytest.approx(float(weight @ x), abs=1e-9)


def test_written_files_come_back(spark, tmp_path):
    rows = [("a", 8000, 1, [0.0, 0.5, -0.5, 2.0]), ("deep/b", 44100, 2, [0.25, -0.25]), ("none", 8000, 1, [])]
    audio.write_audio(spark.createDataFrame(rows, "name string, sample_rate int, channels int, samples array<double>"), str(tmp_path / "out"))
    got = {r.path.rsplit("/", 1)[-1]: r for r in audio.read_audio(spark, str(tmp_path / "out"), normalize=False).collect()}
    assert got["a.wav"].samples == pytest.approx([0, 0.5, -0.5, 32767 / 32768]) and got["b.wav"].samples == pytest.approx([0.0])
    assert got["none.wav"].samples == [] and got["none.wav"].duration == 0 and len(got) == 3


def test_padding_stays_under_its_share_on_skewed_lengths(spark):
    rng = np.random.default_rng(2)
    size = [*rng.integers(1, 40, 600).tolist(), *[17] * 400, *rng.integers(500, 900, 30).tolist(), 30_000]
    rows = [(i % 900, [float(i)] * n) for i, n in enumerate(size)] + [(5000, []), (5001, None)]
    made = O.in_batches(spark.createDataFrame(rows, "id long, samples array<double>").repartition(5), "id", "samples", budget=2000)
    sums = O.padding(made).first()
    assert sums.rows == len(size) and sums.share < 0.1
    worst = made.groupBy("bucket", "batch").agg({"*": "count", "samples": "first"}).collect()
    each = made.selectExpr("bucket", "batch", "size(samples) n").groupBy("bucket", "batch").agg({"n": "max", "*": "count"}).collect()
    assert all(r["max(n)"] * r["count(1)"] <= 2000 or r["count(1)"] == 1 for r in each) and len(worst) == sums.batches
    assert O.in_batches(spark.createDataFrame([], "id long, samples array<double>"), "id", "samples").count() == 0


def test_features_see_no_padding(spark):
    rows = [("x", [1.0, 2.0, 3.0, 4.0, 5.0]), ("y", [7.0])]
    got = O.frame_features(O.in_batches(spark.createDataFrame(rows, "id string, samples array<double>"), "id", "samples"), O.moments(2, 2)).collect()
    assert sorted((r.id, r.frame, *r.features) for r in got) == [("x", 0, 1.5, 2.5), ("x", 1, 3.5, 12.5), ("y", 0, 7.0, 49.0)]


def test_features_by_path(spark, folder):
    got = {}
    for r in audio.path_features(spark, str(folder), 8000, O.moments(4, 4)).collect():
        got.setdefault(r.id.rsplit("/", 1)[-1], {})[r.frame] = r.features
    assert set(got) == {"tone.wav", "u8.WAV", "s24.wav", "f32.wav", "cut.wav"} and len(got["tone.wav"]) == 500
    assert got["f32.wav"][0] == pytest.approx([-0.25, 0.625]) and got["s24.wav"][0] == pytest.approx([-1 / 6, 1.25 / 3])


def test_pooled_tokens_of_ragged_rows(spark):
    rows = [(1, [1.0, 0.0, 0.0, 1.0, 9.0, 9.0], [1, 1, 0]), (2, [3.0, 4.0], [1]), (3, [3.0, 4.0], [0]), (4, [], []), (5, None, [1]), (6, [1.0, 2.0, 2.0], [1]), (7, [1.0], [1, 1])]
    got = {r.id: r.vec for r in O.pooled_tokens(spark.createDataFrame(rows, "k long, flat array<double>, mask array<int>").repartition(2), "k", "flat", "mask").collect()}
    assert set(got) == {1, 2, 3, 6} and got[1] == pytest.approx([0.5**0.5] * 2) and got[2] == pytest.approx([0.6, 0.8])
    assert got[3] == [0, 0] and got[6] == pytest.approx([1 / 3, 2 / 3, 2 / 3])


def test_examples_of_great_and_missing_values_equal_their_sql(spark, tmp_path):
    import duckdb

    from plexure.registry import ORACLE_SQL, QUERIES

    rows = [(1, 1, 700.0), (2, 1, 90000.0), (3, 1, None), (4, None, 3.0), (5, -7, -2000.26), (6, 2, 1.5e6), (7, None, 5.25)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    for name in ("audio_examples", "audio_durations"):
        out = QUERIES[name](spark, str(tmp_path))
        found = con.execute(f"SELECT {', '.join(out.columns)} FROM ({ORACLE_SQL[name]})").fetchall()
        assert sorted(map(repr, found)) == sorted(repr(tuple(r)) for r in out.collect())
