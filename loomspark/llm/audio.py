"""Audio columns: 8-bit samples in a WAV form, log-mel tensors and time spans from its bytes."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions.ship import ship
from loomspark.llm.expressions import whole

RATE = 16_000
UNIT = 192
#: Bytes before the samples.
HEADER = 44
#: The resampling ratio and the filter's taps; frames and their distance in resampled samples; mel bands.
UP, DOWN, TAPS = 1, 2, 32
FRAME, HOP, MELS = 256, 128, 24
#: Frames of a tensor and the frames between two; dB about the mean at which activity begins and ends; frames at a time.
PATCH, PATCH_HOP = 16, 8
BEGIN_DB, END_DB = 0.5, -0.5
BLOCK = 8192


def payload_of(text: bytes) -> bytes:
    """The text with bytes 32 up to a positive multiple of UNIT."""
    return text + b" " * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def store(samples: bytes, rate: int = RATE) -> bytes:
    """A WAV form of one channel of unsigned 8-bit samples."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + len(samples) % 2, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples + b"\0" * (len(samples) % 2)


def load(media: bytes) -> tuple[bytes, int]:
    """The samples and the rate of a stored form."""
    kind, _, form, _, _, code, channels, rate, _, _, bits, tag, n = struct.unpack_from("<4sI4s4sIHHIIHH4sI", media)
    if (kind, form, code, channels, bits, tag) != (b"RIFF", b"WAVE", 1, 1, 8, b"data") or len(media) < HEADER + n:
        raise ValueError("not a stored form of 8-bit samples")
    return media[HEADER : HEADER + n], rate


@cache
def low_pass(up: int, down: int, taps: int) -> np.ndarray:
    """A windowed sinc for the lower of the two rates, `taps` for each of the `up` phases: (up, taps)."""
    n = np.arange(taps * up) - (taps * up - 1) / 2
    cut = 1 / max(up, down)
    h = cut * np.sinc(cut * n) * np.hamming(taps * up) * up
    return np.ascontiguousarray(h.reshape(taps, up).T.astype(np.float32))


def resample(samples: np.ndarray, begin: int, end: int, up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """Outputs `begin` to `end` of 8-bit samples at up / down of their rate; only the samples they need are touched.

    Output m is phase m * down % up of the filter over the taps that end at sample m * down // up;
    before the first and after the last sample there is silence.
    """
    phases, out = low_pass(up, down, taps), np.zeros(max(0, end - begin), np.float32)
    for k in range(min(up, len(out))):
        m = np.arange(begin + k, end, up)
        last = m * down // up
        first = int(last[0]) - taps + 1
        near = samples[max(0, first) : int(last[-1]) + 1].astype(np.float32)
        near = (near - 128) / 128
        x = np.zeros(int(last[-1]) - first + 1, np.float32)
        x[max(0, -first) : max(0, -first) + len(near)] = near
        h = phases[(begin + k) * down % up]
        # every down-th place of a convolution: the filter's own phases, each over every down-th sample
        for j in range(down):
            part = np.convolve(x[taps - 1 - j - (taps - 1 - j) // down * down :: down], h[j::down])
            at = (taps - 1 - j) // down
            out[k::up] += part[at : at + len(m)]
    return out


@cache
def mel_bands(rate: int, frame: int, bands: int) -> np.ndarray:
    """Triangles at equal distances on the mel scale: (frame // 2 + 1, bands)."""
    mel = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, mel, bands + 2) / 2595) - 1)
    f = np.arange(frame // 2 + 1) * rate / frame
    rise = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


@cache
def hann(frame: int) -> np.ndarray:
    return np.hanning(frame + 1)[:-1].astype(np.float32)


def log_mel(samples: bytes, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """Hundredths of log10 mel energy (frames, MELS) as int16, and each frame's energy in hundredths of dB."""
    x = np.frombuffer(samples, np.uint8)
    n = -(-len(x) * UP // DOWN)
    frames = max(1, 1 + -(-(n - FRAME) // HOP))
    bands, window = mel_bands(rate * UP // DOWN, FRAME, MELS), hann(FRAME)
    mels, energy = np.empty((frames, MELS), np.int16), np.empty(frames, np.int32)
    for a in range(0, frames, BLOCK):
        b = min(frames, a + BLOCK)
        y = np.zeros((b - a - 1) * HOP + FRAME, np.float32)
        end = min(n, a * HOP + len(y))
        y[: end - a * HOP] = resample(x, a * HOP, end)
        cut = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP] * window
        power = np.square(np.abs(np.fft.rfft(cut, axis=1)))
        mels[a:b] = np.rint(100 * np.log10(np.maximum(power @ bands, 1e-6)))
        energy[a:b] = np.rint(1000 * np.log10(np.maximum(np.square(cut).mean(axis=1), 1e-9)))
    return mels, energy


def active_spans(energy: np.ndarray) -> np.ndarray:
    """(begin, end) frames of activity: it begins above BEGIN_DB over the mean and lasts until below END_DB."""
    mean = energy.mean()
    event = np.where(energy > mean + 100 * BEGIN_DB, 1, np.where(energy < mean + 100 * END_DB, -1, 0))
    last = np.maximum.accumulate(np.where(event != 0, np.arange(len(event)), -1))
    on = np.concatenate(([False], (last >= 0) & (event[last] == 1), [False]))
    turn = np.nonzero(on[1:] != on[:-1])[0]
    return turn.reshape(-1, 2)


def tensors(mels: np.ndarray, energy: np.ndarray, rate: int) -> bytes:
    """An Arrow stream: fixed-shape tensors (PATCH, MELS) that overlap, begin and end in ms, active frames of each.

    The last tensor is filled up with its last frame; its span ends where the frames do.
    """
    n, ms = len(mels), 1000 * HOP * DOWN / (rate * UP)
    begins = np.arange(0, max(1, n - (PATCH - PATCH_HOP)), PATCH_HOP)
    patches = mels[np.minimum(begins[:, None] + np.arange(PATCH), n - 1)]
    on = np.zeros(n + 1, np.int64)
    for a, b in active_spans(energy):
        on[a + 1 : b + 1] = 1
    total, ends = np.cumsum(on), np.minimum(begins + PATCH, n)
    batch = pa.record_batch({
        "tensor": pa.FixedShapeTensorArray.from_numpy_ndarray(np.ascontiguousarray(patches)),
        "begin_ms": pa.array(begins * ms), "end_ms": pa.array(ends * ms), "active": pa.array(total[ends] - total[begins]),
    })
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as to:
        to.write_batch(batch)
    return out.getvalue().to_pybytes()


def read_tensors(stream: bytes) -> pa.Table:
    return pa.ipc.open_stream(stream).read_all()


def feature_of(stream: bytes, energy: np.ndarray) -> str:
    """Tensors, spans of activity, active share in 1/1000, mean log energy and a checksum of the tensors read back."""
    found = read_tensors(stream)
    values = found.column("tensor").combine_chunks()
    values = (values.chunk(0) if isinstance(values, pa.ChunkedArray) else values).to_numpy_ndarray()
    spans = active_spans(energy)
    share = round(1000 * int((spans[:, 1] - spans[:, 0]).sum()) / len(energy))
    return f"{len(values)};{len(spans)};{share};{int(values.astype(np.int64).sum()) // values.size};{zlib.crc32(values.tobytes()):08x}"


def audio_columns(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media, tensors (an Arrow stream, see `tensors`) and feature of each row of `docs` (doc_id, text).

    The whole text's UTF-8 bytes, filled up by `payload_of`, are the samples; everything after is
    computed from the bytes read back from `media`, a document at a time, in blocks of BLOCK frames.
    Null text: as empty, UNIT blanks. Null doc_id and repeated rows: a row each; equal texts give
    equal values. Empty table: no rows. Other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, media, streams, features = [], [], [], []
            held, begun = 0, 0

            def made(k: int, b=b, sizes=sizes, media=media, streams=streams, features=features) -> pa.RecordBatch:  # noqa: B006
                out = pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(k, len(sizes)), pa.array(sizes, pa.int64()), pa.array(media, pa.binary()), pa.array(streams, pa.binary()), pa.array(features, pa.string())],
                    names=["doc_id", "n_bytes", "media", "tensors", "feature"],
                )
                for x in (sizes, media, streams, features):
                    x.clear()
                return out

            for k, x in enumerate(b.column("text")):
                text = x.as_buffer().to_pybytes()
                form = store(payload_of(text))
                mels, energy = log_mel(*load(form))
                stream = tensors(mels, energy, RATE)
                sizes.append(len(text))
                media.append(form)
                streams.append(stream)
                features.append(feature_of(stream, energy))
                held += len(form) + len(stream)
                if held > 1 << 24:
                    yield made(begun)
                    held, begun = 0, k + 1
            if sizes:
                yield made(begun)

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole("text").cast("binary").alias("text")).mapInArrow(
        run, "doc_id long, n_bytes long, media binary, tensors binary, feature string"
    )
