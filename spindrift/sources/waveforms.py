"""Waveforms: PCM files as overlapping blocks, their windows' scores and their frames' features.

``WaveSource`` reads RIFF files of whole-number or float PCM. A range of a file's bytes has the blocks that begin there, and a partition is one range or
many small ones, so a long file is many tasks' work, many short files are one task's, and none holds more than a few blocks. Files are reached through pyarrow's file systems.
Transforms are numpy's, in Arrow batches.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import BinaryIO, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from spindrift.sources.pieces import located

BLOCKS = "path string, rate int, frames long, block long, first_frame long, samples array<float>"


class Header(NamedTuple):
    rate: int
    channels: int
    width: int
    floating: bool
    start: int
    frames: int


def header(file: BinaryIO, path: str) -> Header:
    """The format of a RIFF file, and where its samples begin."""
    if (top := file.read(12))[:4] != b"RIFF" or top[8:12] != b"WAVE":
        raise ValueError(f"No waveform: {path}")
    kind = None
    while len(chunk := file.read(8)) == 8:
        name, size = chunk[:4], struct.unpack("<I", chunk[4:])[0]
        if name == b"fmt ":
            body = file.read(size + size % 2)
            kind = struct.unpack("<HHIIHH", body[:16])
            code = struct.unpack("<H", body[24:26])[0] if kind[0] == 0xFFFE and size >= 26 else kind[0]
        elif name == b"data":
            if kind is None or code not in (1, 3) or kind[5] // 8 not in (1, 2, 3, 4):
                raise ValueError(f"Not plain PCM: {path}")
            at, width = file.tell(), kind[5] // 8
            file.seek(0, 2)
            whole = min(size, file.tell() - at)  # a file cut short has fewer
            return Header(kind[2], kind[1], width, code == 3, at, whole // (width * kind[1]))
        else:
            file.seek(size + size % 2, 1)
    raise ValueError(f"No samples: {path}")


def decoded(raw: bytes, h: Header) -> np.ndarray:
    """Samples from -1 to 1, channels averaged."""
    if h.floating:
        flat = np.frombuffer(raw, "<f4").astype(np.float32)
    elif h.width == 1:
        flat = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif h.width == 3:
        parts = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        flat = ((parts[:, 0] << 8 | parts[:, 1] << 16 | parts[:, 2] << 24) >> 8).astype(np.float32) / (1 << 23)
    else:
        flat = np.frombuffer(raw, f"<i{h.width}").astype(np.float32) / float(1 << (8 * h.width - 1))
    return flat.reshape(-1, h.channels).mean(axis=1, dtype=np.float32)


def read_frames(file: BinaryIO, h: Header, first: int, n: int) -> np.ndarray:
    first = min(max(0, first), h.frames)
    file.seek(h.start + first * h.width * h.channels)
    return decoded(file.read(max(0, min(n, h.frames - first)) * h.width * h.channels), h)


def plan(h: Header, chunk_seconds: float, overlap_seconds: float) -> tuple[int, int, int]:
    """Frames from one block to the next, frames of a block, and number of blocks: the last is the first that its chunk ends the file in."""
    chunk, overlap = max(h.rate, int(chunk_seconds * h.rate)), max(0, round(overlap_seconds * h.rate))
    if overlap >= chunk:
        raise ValueError("blocks must be longer than what they overlap")
    step = chunk - overlap
    return step, chunk + overlap, 0 if h.frames == 0 else -(-max(0, h.frames - chunk) // step) + 1


@dataclass
class Bytes(InputPartition):
    """Ranges of files: path, first byte and the byte after the last."""

    ranges: list[tuple[str, int, int]]


#: What opening a file counts as in bytes, and the samples that go out in one batch of blocks.
OPENING, BATCH_SAMPLES = 256 << 10, 1 << 18


def packed(files: Iterable[tuple[str, int]], split: int, pack: int) -> list[InputPartition]:
    """Files (path, size) cut into ranges of ``split`` bytes, and neighbouring ranges put together up to ``pack`` bytes with what opening costs."""
    found: list[InputPartition] = []
    ranges: list[tuple[str, int, int]] = []
    cost = 0
    for path, size in files:
        for first in range(0, max(size, 1), split):
            last = min(first + split, size)
            joined = ranges and ranges[-1][0] == path
            more = last - first + (0 if joined else OPENING)
            if ranges and cost + more > pack:
                found.append(Bytes(ranges))
                ranges, cost, joined, more = [], 0, False, last - first + OPENING
            if joined:
                ranges[-1] = (path, ranges[-1][1], last)
            else:
                ranges.append((path, first, last))
            cost += more
    return [*found, Bytes(ranges)] if ranges else found


class WaveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.chunk, self.overlap = float(options.get("chunkseconds", 600)), float(options.get("overlapseconds", 8))
        self.split, self.pack = int(options.get("splitbytes", 64 << 20)), int(options.get("packbytes", 64 << 20))

    def partitions(self) -> list[InputPartition]:
        """Ranges of files by their sizes; no file is opened."""
        store, path = located(self.path)
        info = store.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True))
        waves = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(".wav"))
        return packed(waves, self.split, self.pack)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        assert isinstance(partition, Bytes)
        store, _ = located(self.path)
        rows: list[tuple] = []
        held = 0
        for path, first, last in partition.ranges:
            with store.open_input_file(path) as file:
                h = header(file, path)
                step, size, n = plan(h, self.chunk, self.overlap)
                frame = h.width * h.channels
                for k in range(max(0, -(-(first - h.start) // (step * frame))), n):
                    if h.start + k * step * frame >= last:
                        break
                    samples = read_frames(file, h, k * step, size)
                    if rows and held + len(samples) > BATCH_SAMPLES:
                        yield block_rows(rows)
                        rows, held = [], 0
                    rows.append((path, h.rate, h.frames, k, k * step, samples))
                    held += len(samples)
        if rows:
            yield block_rows(rows)


def block_rows(rows: list[tuple]) -> pa.RecordBatch:
    """A batch of blocks, whose samples are one array cut by offsets."""
    path, rate, frames, block, first, samples = zip(*rows, strict=True)
    ends = np.cumsum([0, *map(len, samples)], dtype=np.int32)
    values = [pa.array(path), pa.array(rate, pa.int32()), pa.array(frames, pa.int64()), pa.array(block, pa.int64()), pa.array(first, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(samples), pa.float32()))]
    return pa.RecordBatch.from_arrays(values, ["path", "rate", "frames", "block", "first_frame", "samples"])


class WaveSource(DataSource):
    """Options: path (a file, or a folder searched at any depth), chunkSeconds, overlapSeconds, splitBytes (of a range), packBytes (of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "waveforms"

    def schema(self) -> str:
        return BLOCKS

    def reader(self, schema: StructType) -> DataSourceReader:
        return WaveReader({k.lower(): v for k, v in self.options.items()})


def excerpts(windows: DataFrame, path_col: str = "path", start_col: str = "start_ms", end_col: str = "end_ms") -> DataFrame:
    """Windows of files with their samples: one frame at least, none where the window begins at the file's end."""
    names = [path_col, start_col, end_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                path, start, end = (row.column(c)[0].as_py() for c in names)
                store, where = located(path)
                with store.open_input_file(where) as file:
                    h = header(file, path)
                    samples = read_frames(file, h, int(start / 1000 * h.rate), max(1, int((end - start) / 1000 * h.rate)))
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([h.rate], pa.int32()), pa.array([samples], pa.list_(pa.float32()))], [*row.schema.names, "rate", "samples"])

    schema = StructType(windows.schema.fields)
    return windows.mapInArrow(run, StructType([*schema.fields, *StructType.fromDDL("rate int, samples array<float>").fields]))


#: Samples whose spectrum counts, the bands' borders as shares of it, and the weights of energy and bands.
SPECTRUM_SAMPLES = 32_768
MIDDLE, HIGH = (0.02, 0.45), (0.45, 0.9)
ENERGY_WEIGHT, MIDDLE_WEIGHT, HIGH_WEIGHT = 0.6, 1e-6, 5e-7


def window_score(samples: np.ndarray) -> float:
    """Loudness and weighted sums of the middle and high bands of a window's spectrum; 0 for no samples. Samples are 16-bit numbers."""
    if not len(samples):
        return 0.0
    x = samples.astype(np.float64)
    spectrum = np.abs(np.fft.rfft(x[:SPECTRUM_SAMPLES]))
    share = np.linspace(0, 1, len(spectrum))
    middle, high = spectrum[(share > MIDDLE[0]) & (share < MIDDLE[1])].sum(), spectrum[(share >= HIGH[0]) & (share < HIGH[1])].sum()
    return float(np.sqrt(np.mean(x * x)) / 32_768 * ENERGY_WEIGHT + middle * MIDDLE_WEIGHT + high * HIGH_WEIGHT)


def _per_row(rows: DataFrame, column: str, run: Callable[[np.ndarray, dict], list], fields: str, others: tuple[str, ...] = ()) -> DataFrame:
    """Rows with more columns, worked out from an array of numbers (null as empty) row by row within Arrow batches."""
    more = StructType.fromDDL(fields)
    schema = StructType([*rows.schema.fields, *more.fields])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(more)
        for batch in batches:
            for at in range(0, batch.num_rows, 16):  # a few series at a time
                part = batch.slice(at, 16)
                given = [part.column(c).to_pylist() for c in others]
                found = [run(np.array(x.values.to_numpy(zero_copy_only=False) if x.is_valid else [], dtype=np.float64), dict(zip(others, g, strict=True))) for x, g in zip(part.column(column), zip(*given, strict=True) if others else [()] * part.num_rows, strict=True)]
                columns = [pa.array([f[k] for f in found], kinds.field(k).type) for k in range(len(kinds))]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], schema.names)

    return rows.mapInArrow(each, schema)


def with_score(windows: DataFrame, column: str = "samples", scale: float = 1.0) -> DataFrame:
    """Windows with score; ``scale`` turns the samples into 16-bit numbers (32768 for samples from -1 to 1)."""
    return _per_row(windows, column, lambda x, _: [window_score(np.trunc(x * scale))], "score double")


FRAME = 2048
#: Share of a frame's magnitude below its roll-off; least power that counts.
ROLL_OFF, FLOOR = 0.85, 1e-10
BANDS = 6


def frames_of(x: np.ndarray, hop: int, size: int = FRAME) -> np.ndarray:
    """Overlapping frames centred at every hop, zeros beyond the ends."""
    padded = np.concatenate([np.zeros(size // 2), x, np.zeros(size // 2)])
    return np.lib.stride_tricks.sliding_window_view(padded, size)[: len(x) + 1 : hop]


def spectral(x: np.ndarray, rate: int, hop: int, size: int = FRAME) -> dict[str, np.ndarray]:
    """Features of frames: rms, zcr, flatness, rolloff (Hz), onset, contrast (dB, mean of bands) and chroma (twelve shares, the largest 1)."""
    cut = frames_of(x, hop, size)
    magnitude = np.abs(np.fft.rfft(cut * np.hanning(size + 1)[:-1], axis=1))
    power = np.maximum(magnitude**2, FLOOR)
    hertz = np.fft.rfftfreq(size, 1 / rate)
    reached = np.cumsum(magnitude, axis=1) >= ROLL_OFF * magnitude.sum(axis=1, keepdims=True)
    decibels = 10 * np.log10(power)
    rise = np.maximum(0, np.diff(decibels, axis=0, prepend=decibels[:1])).mean(axis=1)
    pitch = np.zeros(len(hertz), dtype=np.int64)
    pitch[1:] = np.round(12 * np.log2(hertz[1:] / 440.0) + 9).astype(np.int64) % 12  # 0 is C
    audible = (hertz >= 55) & (hertz <= 7040)
    chroma = np.stack([power[:, audible & (pitch == k)].sum(axis=1) for k in range(12)], axis=1)
    chroma = np.where(magnitude.sum(axis=1, keepdims=True) > 0, chroma / np.maximum(chroma.max(axis=1, keepdims=True), FLOOR), 0.0)
    contrast = []
    edges = [0.0, *(200.0 * 2**k for k in range(BANDS)), np.inf]
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        band = np.sort(decibels[:, (hertz >= low) & (hertz < high)], axis=1)
        if band.shape[1]:
            n = max(1, band.shape[1] // 50)
            contrast.append(band[:, -n:].mean(axis=1) - band[:, :n].mean(axis=1))
    return {
        "rms": np.sqrt((cut**2).mean(axis=1)), "zcr": (np.diff(np.signbit(cut), axis=1)).mean(axis=1), "flatness": np.exp(np.log(power).mean(axis=1)) / power.mean(axis=1),
        "rolloff": hertz[reached.argmax(axis=1)], "onset": rise, "contrast": np.mean(contrast, axis=0), "chroma": chroma,
    }


def averaged(x: np.ndarray, context: int) -> np.ndarray:
    """Mean over ``context`` frames from context // 2 before, the ends repeated."""
    if context <= 1 or not len(x):
        return x
    padded = np.concatenate([np.repeat(x[:1], context // 2, axis=0), x, np.repeat(x[-1:], context - 1 - context // 2, axis=0)])
    sums = np.cumsum(np.concatenate([np.zeros_like(padded[:1]), padded]), axis=0)
    return (sums[context:] - sums[:-context]) / context


def scaled(x: np.ndarray) -> np.ndarray:
    """To 0..1 between least and most; all zero where these are next to equal."""
    span = x.max() - x.min() if len(x) else 0
    return (x - x.min()) / span if span > 1e-9 else np.zeros(len(x))


FEATURES = "idx int, start_ms long, rms double, flatness double, rolloff double, zcr double, onset double, chroma double, contrast double, chroma_vector array<double>"


def block_features(samples: np.ndarray, rate: int, hop_seconds: float, context_seconds: float) -> list[dict]:
    """Frames of a block with features averaged over the context and scaled to 0..1 within the block."""
    if not len(samples):
        return []
    hop = max(1, int(rate * hop_seconds))
    context = max(1, round(context_seconds / max(hop_seconds, 0.25)))
    found = {k: averaged(v, context) for k, v in spectral(samples, rate, hop).items()}
    strength = scaled(np.linalg.norm(found["chroma"], axis=1))
    whole = {k: scaled(found[k]) for k in ("rms", "flatness", "rolloff", "zcr", "onset", "contrast")}
    return [{"idx": k, "start_ms": int(k * hop_seconds * 1000), **{c: float(v[k]) for c, v in whole.items()}, "chroma": float(strength[k]), "chroma_vector": found["chroma"][k].tolist()} for k in range(len(strength))]


def features(blocks: DataFrame, hop_seconds: float = 1.0, context_seconds: float = 4.0, rate: str = "rate", column: str = "samples") -> DataFrame:
    """Rows of blocks, without their samples, for each frame: what ``segmentation.scores`` and ``frame_label`` take.

    start_ms counts from the block's beginning. Null or empty samples give no frames.
    """
    from pyspark.sql import functions as F

    found = _per_row(blocks, column, lambda x, row: [block_features(x, row[rate], hop_seconds, context_seconds)], f"_frames array<struct<{FEATURES.replace(' array', ':array').replace(' int', ':int').replace(' long', ':long').replace(' double', ':double')}>>", (rate,))
    return found.drop(column).select("*", F.inline("_frames")).drop("_frames")


def on_one_timeline(frames: DataFrame, hop_key: str = "start_ms", context_seconds: float = 4.0) -> DataFrame:
    """Frames of overlapping blocks (path, rate, frames, block, first_frame, start_ms, ...) at their place in the file, each place once.

    A place that several blocks reach is that of the first of them; places at or beyond the end are left out.
    """
    from pyspark.sql import functions as F

    at = F.floor(F.col("first_frame") / F.col("rate") * 1000) + F.col(hop_key)
    length = F.floor(F.col("frames") / F.col("rate") * 1000)
    rows = frames.withColumns({hop_key: at.cast("long"), "_length": length}).where(F.col(hop_key) < F.col("_length"))
    others = [c for c in rows.columns if c not in ("path", hop_key)]
    one = rows.groupBy("path", hop_key).agg(F.min_by(F.struct(*others), F.struct("block", "idx")).alias("_one"))
    found = one.select("path", hop_key, "_one.*")
    return found.withColumn("end_ms", F.least(F.col("_length"), F.col(hop_key) + int(context_seconds * 1000)).cast("long")).drop("_length", "block", "first_frame", "idx")
