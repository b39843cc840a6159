"""Captures of complex samples: a raw file with a JSON sidecar, WAV files, and their tables.

Spark has no complex type, so samples are two arrays of floats. The data source gives one partition for each
range of samples, and an executor reads its range only.
"""

from __future__ import annotations

import io
import json
import math
import os
import tempfile
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: NumPy type, scale and offset of each encoding of one component.
ENCODINGS = {
    "cu8": ("u1", 127.5, 127.5), "ci8": ("i1", 128.0, 0.0), "ci16": ("<i2", 32768.0, 0.0), "ci16q11": ("<i2", 2048.0, 0.0), "cf32": ("<f4", 1.0, 0.0)
}


def to_complex(data: bytes, kind: str) -> np.ndarray:
    """Interleaved samples at unit scale; a half sample at the end is left out."""
    code, scale, offset = ENCODINGS[kind]
    raw = np.frombuffer(data, code, len(data) // np.dtype(code).itemsize // 2 * 2).astype(np.float32)
    raw = (raw - offset) / scale
    return raw[0::2] + 1j * raw[1::2]


def from_complex(x: np.ndarray, kind: str) -> bytes:
    code, scale, offset = ENCODINGS[kind]
    flat = np.empty(2 * len(x), np.float64)
    flat[0::2], flat[1::2] = x.real, x.imag
    flat = flat * scale + offset
    if kind != "cf32":
        info = np.iinfo(code)
        flat = np.clip(np.rint(flat), info.min, info.max)
    return flat.astype(code).tobytes()


def channels(x: np.ndarray, count: int) -> np.ndarray:
    """Sample-interleaved channels as rows."""
    return x[: len(x) // count * count].reshape(-1, count).T


def read_meta(base: str) -> dict:
    with open(base + ".json", encoding="utf-8") as f:
        return json.load(f)


def write_meta(base: str, meta: dict) -> None:
    """Replace the sidecar at once: readers see the old or the new one."""
    fd, draft = tempfile.mkstemp(dir=os.path.dirname(base) or ".")
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        json.dump(meta, f)
    os.replace(draft, base + ".json")


def write_pair(
    base: str, x: np.ndarray, rate: float, centre_hz: float = 0.0, kind: str = "cf32", labels: list[dict] = (), extra: dict | None = None
) -> None:
    with open(base + ".iq", "wb") as f:
        f.write(from_complex(x, kind))
    write_meta(
        base,
        {
            "kind": kind, "rate": rate, "captures": [{"start": 0, "centre_hz": centre_hz}], "labels": sorted(labels, key=lambda a: a["start"]),
            **(extra or {})
        }
    )


def sample_count(base: str, meta: dict | None = None) -> int:
    kind = (meta or read_meta(base))["kind"]
    return os.path.getsize(base + ".iq") // (2 * np.dtype(ENCODINGS[kind][0]).itemsize)


def load(base: str, start: int = 0, count: int | None = None) -> np.ndarray:
    kind = read_meta(base)["kind"]
    width = 2 * np.dtype(ENCODINGS[kind][0]).itemsize
    with open(base + ".iq", "rb") as f:
        f.seek(start * width)
        return to_complex(f.read() if count is None else f.read(count * width), kind)


def meta_problems(meta: dict) -> list[str]:
    """What is wrong with a sidecar, in sentences."""
    out = []
    if meta.get("kind") not in ENCODINGS:
        out.append(f"The encoding {meta.get('kind')!r} is not known.")
    if not isinstance(meta.get("rate"), int | float) or not meta["rate"] > 0:
        out.append("The sample rate must be a positive number.")
    starts = [c.get("start", -1) for c in meta.get("captures", [])]
    if not starts or starts != sorted(starts) or starts[0] != 0:
        out.append("Captures must begin at 0 and be in order.")
    for i, a in enumerate(meta.get("labels", [])):
        if a.get("start", -1) < 0 or a.get("count", 0) < 0:
            out.append(f"Label {i} has a negative start or length.")
        if "low_hz" in a and "high_hz" in a and a["low_hz"] > a["high_hz"]:
            out.append(f"Label {i} has its frequencies in the wrong order.")
    return out


class _Range(InputPartition):
    def __init__(self, base: str, start: int, count: int):
        self.base, self.start, self.count = base, start, count


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.bases = options["path"].split(",")
        self.size, self.block = int(options.get("partition", 1 << 22)), int(options.get("block", 65536))

    def partitions(self) -> list[InputPartition]:
        return [_Range(b, s, min(self.size, n - s)) for b in self.bases for n in [sample_count(b)] for s in range(0, n, self.size)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        for at in range(partition.start, partition.start + partition.count, self.block):
            x = load(partition.base, at, min(self.block, partition.start + partition.count - at))
            yield os.path.basename(partition.base), at, x.real.tolist(), x.imag.tolist()


class CaptureSource(DataSource):
    """``spark.dataSource.register(CaptureSource)``, then ``spark.read.format("capture").load(base)``; several bases are joined by commas."""

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return "capture_id string, start long, re array<float>, im array<float>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


def power_dbfs(blocks: DataFrame) -> DataFrame:
    """Per capture: samples, mean power in dB of full scale, share of samples at the rails."""
    square = F.aggregate(F.zip_with("re", "im", lambda a, b: a.cast("double") * a + b.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    rail = F.size(F.filter(F.zip_with("re", "im", lambda a, b: F.greatest(F.abs(a), F.abs(b))), lambda x: x >= 0.999))
    return blocks.groupBy("capture_id").agg(
        F.sum(F.size("re")).alias("samples"), (10 * F.log10(F.sum(square) / F.sum(F.size("re")))).alias("dbfs"),
        (F.sum(rail) / F.sum(F.size("re"))).alias("clipped")
    )


def decode(data: Column, kind: str) -> Column:
    """{re, im} of a binary column."""

    @F.pandas_udf("re array<float>, im array<float>")
    def run(col: pd.Series) -> pd.DataFrame:
        parts = [to_complex(bytes(b or b""), kind) for b in col]
        return pd.DataFrame({"re": [p.real for p in parts], "im": [p.imag for p in parts]})

    return run(data)


def read_wav(data: bytes) -> tuple[float, np.ndarray, int]:
    """Rate, mean of the channels at unit scale, samples at the rails, of 8, 16 or 32 bit PCM."""
    with wave.open(io.BytesIO(data)) as w:
        width, n, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
        raw = w.readframes(w.getnframes())
    code, scale, offset = {1: ("u1", 128.0, 128.0), 2: ("<i2", 32768.0, 0.0), 4: ("<i4", 2147483648.0, 0.0)}[width]
    x = (np.frombuffer(raw, code).astype(np.float64) - offset) / scale
    return float(rate), x.reshape(-1, n).mean(axis=1), int((np.abs(x) >= 1 - 1.5 / scale).sum())


def write_wav(x: np.ndarray, rate: int) -> tuple[bytes, int]:
    """16 bit PCM, and how many samples were clipped."""
    over = int((np.abs(x) > 1).sum())
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.clip(np.rint(x * 32767), -32768, 32767).astype("<i2").tobytes())
    return out.getvalue(), over


def wav_files(samples: DataFrame, key: str, rate: int) -> DataFrame:
    """path, content, clipped: the samples (key, at, value) of each series as a WAV file of that name; missing samples are silent.

    A file is one row, so its series must fit in one: it comes together as an array, not as a group in Python.
    """
    packed = samples.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", F.col("value").cast("double").alias("value")))).alias("s"))
    rows = packed.select(F.concat(F.col(key).cast("string"), F.lit(".wav")).alias("path"), F.col("s.at").alias("at"), F.col("s.value").alias("value"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = []
            for at, value in zip(b["at"], b["value"], strict=True):
                x = np.zeros(int(max(at)) + 1)
                x[np.asarray(at, int)] = np.nan_to_num(np.asarray(value, float))
                made.append(write_wav(x, rate))
            yield pd.DataFrame({"path": b["path"], "content": [m[0] for m in made], "clipped": [m[1] for m in made]})

    return rows.mapInPandas(run, "path string, content binary, clipped long")


def wav_table(files: DataFrame) -> DataFrame:
    """path, rate, samples, clipped of files read as ``binaryFile``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [read_wav(bytes(c)) for c in b["content"]]
            yield pd.DataFrame(
                {"path": b["path"], "rate": [r[0] for r in rows], "samples": [r[1].astype(np.float32) for r in rows], "clipped": [r[2] for r in rows]}
            )

    return files.select("path", "content").mapInPandas(run, "path string, rate double, samples array<float>, clipped long")


def _signed(v: np.ndarray) -> np.ndarray:
    """Signed magnitude of 16 bits; all ones is a void."""
    out = np.where(v & 0x8000, -(v & 0x7FFF).astype(np.int32), v.astype(np.int32)).astype(np.float64)
    out[v == 0xFFFF] = np.nan
    return out


def read_dted(data: bytes) -> tuple[float, float, np.ndarray]:
    """South-west corner and heights (rows from the south, columns from the west) of a terrain tile.

    Each column record has its checksum, the sum of its bytes, which must hold.
    """
    if data[:3] != b"UHL":
        raise ValueError("not a terrain tile")
    angle = lambda s: (int(s[:3]) + int(s[3:5]) / 60 + int(s[5:7]) / 3600) * (-1 if s[7:8] in b"WS" else 1)
    west, south, cols, rows = angle(data[4:12]), angle(data[12:20]), int(data[47:51]), int(data[51:55])
    size, out = 12 + 2 * rows, np.empty((rows, cols))
    for c in range(cols):
        rec = data[3428 + c * size : 3428 + (c + 1) * size]
        if len(rec) < size or rec[0] != 0xAA or sum(rec[:-4]) != int.from_bytes(rec[-4:], "big"):
            raise ValueError(f"column {c} is damaged")
        out[:, c] = _signed(np.frombuffer(rec, ">u2", rows, 8))
    return south, west, out


def write_dted(south: float, west: float, heights: np.ndarray) -> bytes:
    def angle(v: float, names: str) -> bytes:
        a = abs(v)
        d, m = int(a), int((a - int(a)) * 60 + 1e-9)
        return f"{d:03d}{m:02d}{round(((a - d) * 60 - m) * 60):02d}{names[v < 0]}".encode()

    rows, cols = heights.shape
    head = (b"UHL1" + angle(west, "EW") + angle(south, "NS")).ljust(47, b"0") + f"{cols:04d}{rows:04d}".encode()
    out = bytearray(head.ljust(3428, b" "))
    for c in range(cols):
        h = heights[:, c]
        v = np.where(np.isnan(h), 0xFFFF, np.where(h < 0, 0x8000 | np.abs(np.nan_to_num(h)).astype(int), np.nan_to_num(h).astype(int))).astype(">u2")
        rec = bytes([0xAA]) + c.to_bytes(3, "big") + c.to_bytes(2, "big") + b"\0\0" + v.tobytes()
        out += rec + sum(rec).to_bytes(4, "big")
    return bytes(out)


def elevation(south: float, west: float, heights: np.ndarray, lat: float, lon: float, size_deg: float = 1.0) -> float:
    """Bilinear height at a place; NaN outside or beside a void."""
    rows, cols = heights.shape
    y, x = (lat - south) / size_deg * (rows - 1), (lon - west) / size_deg * (cols - 1)
    if not (0 <= y <= rows - 1 and 0 <= x <= cols - 1):
        return math.nan
    i, j = min(int(y), rows - 2), min(int(x), cols - 2)
    a, b = y - i, x - j
    return float(
        heights[i, j] * (1 - a) * (1 - b) + heights[i + 1, j] * a * (1 - b) + heights[i, j + 1] * (1 - a) * b + heights[i + 1, j + 1] * a * b
    )


def levels(samples: Column, rail: float = 1.0) -> tuple[Column, Column]:
    """Mean power in dB of full scale, and the share of samples at the rails, of an array of samples."""
    n = F.greatest(F.size(samples), F.lit(1))
    power = F.aggregate(samples, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) / n
    clipped = F.size(F.filter(samples, lambda x: F.abs(x) >= rail)) / n
    return 10 * F.log10(F.greatest(power, F.lit(1e-20))), clipped
