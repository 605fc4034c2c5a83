"""Files by pieces, waveforms by blocks, and their numbers against plain loops."""

import math
import struct
import wave
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.sources import pieces, waveforms


def plain_blocks(n, rate, chunk_seconds, overlap_seconds):
    """Offsets by the loop that reads chunk after chunk."""
    chunk, overlap = max(rate, int(chunk_seconds * rate)), round(overlap_seconds * rate)
    found, offset = [], 0
    while offset < n:
        found.append((offset, min(n, offset + chunk + overlap)))
        if offset + chunk >= n:
            break
        offset += chunk
        if offset >= overlap:
            offset -= overlap
    return found


def save(path, samples, rate=100, width=2, channels=1):
    with wave.open(str(path), "wb") as out:
        out.setnchannels(channels)
        out.setsampwidth(width)
        out.setframerate(rate)
        kinds = {1: "u1", 2: "<i2", 4: "<i4"}
        out.writeframes(samples.astype(kinds[width]).tobytes() if width != 3 else b"".join(int(x).to_bytes(3, "little", signed=True) for x in samples))


def blocks_of(spark, path, **options):
    spark.dataSource.register(waveforms.WaveSource)
    return spark.read.format("waveforms").option("path", str(path)).options(**options).load()


@pytest.mark.parametrize("split", [97, 1 << 20])
def test_blocks_equal_a_plain_reader(spark, tmp_path, split):
    rng = np.random.default_rng(3)
    sizes = {"a": 0, "b": 1, "c": 99, "d": 100, "e": 101, "f": 1234, "sub/g": 777}
    data = {k: rng.integers(-32768, 32768, n) for k, n in sizes.items()}
    (tmp_path / "sub").mkdir()
    for k, x in data.items():
        save(tmp_path / f"{k}.wav", x)
    (tmp_path / "note.txt").write_text("x")
    rows = blocks_of(spark, tmp_path, chunkSeconds="1.5", overlapSeconds="0.3", splitBytes=str(split)).collect()
    got = {(Path(r.path).relative_to(tmp_path).with_suffix("").as_posix(), r.block): (r.first_frame, r.frames, r.samples) for r in rows}
    expected = {(k, i): (a, len(x), (x[a:b] / 32768).tolist()) for k, x in data.items() for i, (a, b) in enumerate(plain_blocks(len(x), 100, 1.5, 0.3))}
    assert len(rows) == len(got) and got == expected


def test_widths_channels_floats_and_faulty_files(spark, tmp_path):
    x = np.array([-100, 0, 50, 100])
    for width, scale in ((1, 128), (2, 32768), (3, 1 << 23), (4, 1 << 31)):
        save(tmp_path / "w.wav", x + 128 if width == 1 else x, width=width)
        assert blocks_of(spark, tmp_path / "w.wav").first().samples == (x / scale).astype(np.float32).tolist()
    save(tmp_path / "w.wav", np.array([10, 30, -10, 10]), channels=2)
    assert blocks_of(spark, tmp_path / "w.wav").first().samples == [20 / 32768, 0.0]
    body = struct.pack("<3f", 0.5, -0.25, 0.0)
    head = b"RIFF" + struct.pack("<I", 0) + b"WAVE" + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"fmt " + struct.pack("<IHHIIHH", 16, 3, 1, 8, 32, 4, 32) + b"data" + struct.pack("<I", 1 << 30)
    (tmp_path / "w.wav").write_bytes(head + body)  # says that it is longer than it is
    assert blocks_of(spark, tmp_path / "w.wav").first().samples == [0.5, -0.25, 0.0]
    (tmp_path / "w.wav").write_bytes(b"no wave at all")
    with pytest.raises(Exception, match="No waveform"):
        blocks_of(spark, tmp_path / "w.wav").collect()
    with pytest.raises(Exception, match="longer than what they overlap"):
        save(tmp_path / "w.wav", x)
        blocks_of(spark, tmp_path / "w.wav", chunkSeconds="1", overlapSeconds="1").collect()


def test_excerpts_and_scores(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = rng.integers(-20000, 20000, 500)
    save(tmp_path / "w.wav", x)
    spans = [(0, 1000), (1500, 2500), (4900, 6000), (5000, 6000), (9000, 9500), (100, 100)]
    windows = spark.createDataFrame([(str(tmp_path / "w.wav"), a, b) for a, b in spans], "path string, start_ms long, end_ms long")
    found = {(r.start_ms, r.end_ms): r for r in waveforms.with_score(waveforms.excerpts(windows), scale=32768).collect()}
    for a, b in spans:
        cut = x[min(500, a // 10) : min(500, a // 10) + max(1, (b - a) // 10)].astype(float)
        score = 0.0
        if len(cut):
            n = len(cut)
            spectrum = [abs(sum(v * complex(math.cos(2 * math.pi * i * k / n), -math.sin(2 * math.pi * i * k / n)) for i, v in enumerate(cut))) for k in range(n // 2 + 1)]
            share = [k / (len(spectrum) - 1) if len(spectrum) > 1 else 0 for k in range(len(spectrum))]
            middle, high = (sum(m for m, s in zip(spectrum, share, strict=True) if lo(s)) for lo in (lambda s: 0.02 < s < 0.45, lambda s: 0.45 <= s < 0.9))
            score = math.sqrt(sum(v * v for v in cut) / n) / 32768 * 0.6 + middle * 1e-6 + high * 5e-7
        assert found[a, b].score == pytest.approx(score, abs=1e-9), (a, b)


def test_features_against_plain_loops():
    rate, hop, size = 8000, 1000, 2048
    t = np.arange(rate) / rate
    rng = np.random.default_rng(5)
    x = np.concatenate([np.sin(2 * np.pi * 261.63 * t), rng.normal(size=rate) * 0.3, np.zeros(rate)])
    found = waveforms.spectral(x, rate, hop, size)
    window = [0.5 - 0.5 * math.cos(2 * math.pi * k / size) for k in range(size)]
    for at in (3, 11, 12, 20, 24):
        cut = [x[at * hop - size // 2 + k] if 0 <= at * hop - size // 2 + k < len(x) else 0.0 for k in range(size)]
        magnitude = np.abs(np.fft.rfft(np.array(cut) * window))
        power = np.maximum(magnitude**2, 1e-10)
        assert found["rms"][at] == pytest.approx(math.sqrt(sum(v * v for v in cut) / size))
        assert found["zcr"][at] == pytest.approx(sum((a < 0) != (b < 0) for a, b in zip(cut, cut[1:], strict=False)) / (size - 1), abs=2e-3)  # minus zero counts as below
        assert found["flatness"][at] == pytest.approx(math.exp(sum(math.log(p) for p in power) / len(power)) / (sum(power) / len(power)))
        total, k = 0.0, 0
        while total + magnitude[k] < 0.85 * magnitude.sum():
            total += magnitude[k]
            k += 1
        assert found["rolloff"][at] == pytest.approx(k * rate / size)
        before = x[(at - 1) * hop - size // 2 : (at - 1) * hop + size // 2]
        earlier = np.maximum(np.abs(np.fft.rfft(before * np.array(window)[: len(before)], size)) ** 2, 1e-10)
        assert found["onset"][at] == pytest.approx(np.maximum(0, 10 * np.log10(power / earlier)).mean(), rel=1e-6)
    assert found["chroma"][4].argmax() == 0 and found["chroma"][4].max() == 1.0  # a C
    assert found["chroma"][21].max() == 0.0  # silence
    assert found["flatness"][12] > 0.3 > found["flatness"][4]
    assert (waveforms.averaged(np.arange(5.0), 3) == [1 / 3, 1, 2, 3, 11 / 3]).all()


def test_frames_of_blocks_join_one_timeline(spark, tmp_path):
    rng = np.random.default_rng(6)
    save(tmp_path / "w.wav", rng.integers(-2000, 2000, 1050))
    blocks = blocks_of(spark, tmp_path, chunkSeconds="4", overlapSeconds="1")
    found = waveforms.on_one_timeline(waveforms.features(blocks, hop_seconds=0.5, context_seconds=1.0), context_seconds=1.0).orderBy("start_ms").collect()
    assert [r.start_ms for r in found] == list(range(0, 10_500, 500))
    assert found[-1].end_ms == 10_500 and all(0 <= r.rms <= 1 for r in found) and len(found[0].chroma_vector) == 12
    assert waveforms.features(blocks.withColumn("samples", F.lit(None).cast("array<float>"))).count() == 0


def test_a_failed_write_leaves_no_file(spark, tmp_path):
    rows = [(f"job/{k % 7}", k, f"{k};") for k in range(200)] + [("empty", 0, None)]
    frame = spark.createDataFrame(rows, "job string, at int, text string").repartition(4)
    pieces.write_files(frame, str(tmp_path / "out"), "job", ["at"], "text", ".csv")
    files = {p.name: p.read_text() for p in (tmp_path / "out").rglob("*.csv")}
    assert files == {**{f"job%2F{j}.csv": "".join(f"{k};" for k in range(j, 200, 7)) for j in range(7)}, "empty.csv": ""}
    broken = frame.withColumn("text", F.when(F.col("at") == 150, F.raise_error(F.lit("broken")).cast("string")).otherwise(F.col("text")))
    with pytest.raises(Exception, match="broken"):
        pieces.write_files(broken, str(tmp_path / "none"), "job", ["at"], "text", ".csv")
    assert not [p for p in (tmp_path / "none").rglob("*") if p.is_file()] and not list((tmp_path / "none").glob("_staging*"))
    with pytest.raises(Exception, match="no name"):
        pieces.write_files(spark.createDataFrame([(None, 1, "x")], "job string, at int, text string"), str(tmp_path / "other"), "job", ["at"], "text")
    spark.dataSource.register(pieces.PiecesSource)
    with pytest.raises(Exception, match="rows .name, piece."):
        spark.createDataFrame([(1, 2)], "a int, b int").write.format("pieces").option("path", str(tmp_path / "x")).mode("append").save()


def test_many_short_files_are_few_partitions(spark, tmp_path):
    """Each range of each file was a task of its own; ranges that are cut between two partitions give each block once."""
    rng = np.random.default_rng(8)
    data = {f"{k:03d}": rng.integers(-32768, 32768, 40 + k % 90) for k in range(200)}
    for k, x in data.items():
        save(tmp_path / f"{k}.wav", x, rate=16)
    for pack, most in ((64 << 20, 2), (waveforms.OPENING * 3, 100), (1, 10_000)):
        blocks = blocks_of(spark, tmp_path, chunkSeconds="1", overlapSeconds="0.25", splitBytes="60", packBytes=str(pack))
        assert blocks.rdd.getNumPartitions() <= most
        got = {(Path(r.path).stem, r.block): (r.first_frame, r.samples) for r in blocks.collect()}
        assert got == {(k, i): (a, (x[a:b] / 32768).tolist()) for k, x in data.items() for i, (a, b) in enumerate(plain_blocks(len(x), 16, 1, 0.25))}
