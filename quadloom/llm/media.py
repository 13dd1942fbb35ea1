"""Telephony audio in a binary column: mu-law, A-law and IMA ADPCM in RIFF/WAVE, decoded to resampled 16-bit PCM.

``store`` puts payloads into WAVE containers as they are (8-bit companded samples, or ADPCM blocks of 64 bytes), so the
payload is read back bit by bit. ``read`` walks the chunks of a stored file. ``decode`` expands mu-law and A-law by lookup
table; ADPCM is stepped sample by sample with numpy, all blocks of a batch at once. ``resample`` doubles the rate with a
four-tap half-band filter in integers, so results don't depend on the machine.

Null text is empty (a payload of 64 zero bytes); a text of any length is stored whole; equal texts give equal values. The
codec follows from the payload's CRC, so a corpus uses all three. Rows that share an id are described each on its own; an
empty table gives no rows; other columns are not read. ``with_pcm`` adds the resampled signal itself as a binary column of
little-endian 16-bit samples, four to eight times the size of the payload.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame

from .common import arrow_map, blocks, materialise, text_bytes

RATE, UNIT = 8000, 64
CODECS = ("mulaw", "alaw", "adpcm")
#: WAVE format tags, and the step sizes and index changes of IMA ADPCM.
TAGS = {"mulaw": 7, "alaw": 6, "adpcm": 17}
STEPS = np.array(
    [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494,
        544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487,
        12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ],
    np.int32,
)
CHANGES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def _mulaw() -> np.ndarray:
    x = ~np.arange(256) & 0xFF
    size = (((x & 15) << 3) + 132 << ((x >> 4) & 7)) - 132
    return np.where(x & 128, -size, size).astype(np.int16)


def _alaw() -> np.ndarray:
    x = np.arange(256) ^ 0x55
    part, low = (x >> 4) & 7, ((x & 15) << 4) + 8
    size = np.where(part == 0, low, (low + 256) << np.maximum(part - 1, 0))
    return np.where(x & 128, size, -size).astype(np.int16)


TABLES = {"mulaw": _mulaw(), "alaw": _alaw()}


def wave(payload: bytes, codec: str) -> bytes:
    """A WAVE file that holds ``payload`` as it is."""
    if codec == "adpcm":
        per_block = (UNIT - 4) * 2 + 1
        form = struct.pack("<HHIIHHHH", TAGS[codec], 1, RATE, RATE * UNIT // per_block, UNIT, 4, 2, per_block)
        samples = len(payload) // UNIT * per_block
    else:
        form, samples = struct.pack("<HHIIHHH", TAGS[codec], 1, RATE, RATE, 1, 8, 0), len(payload)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read(media: bytes) -> tuple[str, bytes]:
    """(codec, payload) of a WAVE file, by its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, codec = 12, None
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            tag = struct.unpack_from("<H", media, at + 8)[0]
            codec = next((c for c, t in TAGS.items() if t == tag), None)
        elif kind == b"data":
            if codec is None:
                raise ValueError("unknown codec")
            return codec, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def decode_adpcm(data: np.ndarray) -> np.ndarray:
    """PCM of blocks of 64 bytes (n, 64) -> (n, 121): all blocks step together."""
    n = len(data)
    out = np.empty((n, (UNIT - 4) * 2 + 1), np.int16)
    value = np.ascontiguousarray(data[:, :2]).view("<i2").reshape(n).astype(np.int32)
    index = np.minimum(data[:, 2], 88).astype(np.int32)
    out[:, 0] = value
    for k in range((UNIT - 4) * 2):
        code = (data[:, 4 + k // 2] >> (4 * (k & 1)) & 15).astype(np.int32)
        step, size = STEPS[index], code & 7
        diff = (step >> 3) + np.where(size & 4, step, 0) + np.where(size & 2, step >> 1, 0) + np.where(size & 1, step >> 2, 0)
        value = np.clip(np.where(code & 8, value - diff, value + diff), -32768, 32767)
        index = np.clip(index + CHANGES[size], 0, 88)
        out[:, k + 1] = value
    return out


def resample(pcm: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Twice the rate: every sample and, between it and the next one, the half-band value; edges repeat within each piece."""
    n = len(pcm)
    if not n:
        return pcm
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    first[offs[:-1][np.diff(offs) > 0]] = True
    last[offs[1:][np.diff(offs) > 0] - 1] = True
    x = pcm.astype(np.int32)
    before = np.where(first, x, np.concatenate([x[:1], x[:-1]]))
    after = np.where(last, x, np.concatenate([x[1:], x[-1:]]))
    later = np.where(last, after, np.concatenate([after[1:], after[-1:]]))
    out = np.empty(2 * n, np.int16)
    out[0::2] = pcm
    out[1::2] = np.clip((9 * (x + after) - before - later + 8) >> 4, -32768, 32767)
    return out


def decode(files: list[tuple[str, bytes]]) -> list[np.ndarray]:
    """Resampled PCM of (codec, payload) pairs, each codec's payloads together."""
    out: list[np.ndarray] = [np.zeros(0, np.int16)] * len(files)
    for codec in CODECS:
        own = [i for i, f in enumerate(files) if f[0] == codec]
        if not own:
            continue
        data = np.frombuffer(b"".join(files[i][1] for i in own), np.uint8)
        sizes = np.array([len(files[i][1]) for i in own])
        if codec == "adpcm":
            pcm, sizes = decode_adpcm(data.reshape(-1, UNIT)).reshape(-1), sizes // UNIT * ((UNIT - 4) * 2 + 1)
        else:
            pcm = TABLES[codec][data]
        offs = np.concatenate([[0], np.cumsum(sizes)])
        twice = resample(pcm, offs)
        for j, i in enumerate(own):
            out[i] = twice[2 * offs[j] : 2 * offs[j + 1]]
    return out


def features(pcm: np.ndarray) -> str:
    x = pcm.astype(np.int64)
    rms = (int((x * x).sum()) / max(1, len(x))) ** 0.5
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"rate={2 * RATE};samples={len(x)};peak={int(np.abs(x).max()) if len(x) else 0};mean={int(x.sum()) // max(1, len(x))};rms={rms:.3f};crossings={crossings}"


def store(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A media table: id, n_bytes, media (a WAVE file with the text's padded UTF-8 bytes)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            raw, offs = text_bytes(batch.column(1))
            for rows in blocks(np.diff(offs)):
                files = []
                for a, b in zip(offs[rows], offs[rows.start + 1 : rows.stop + 1], strict=True):
                    payload = raw[a:b].tobytes()
                    payload += b"\0" * (-len(payload) % UNIT if payload else UNIT)
                    files.append(wave(payload, CODECS[zlib.crc32(payload) % len(CODECS)]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(rows.start, rows.stop - rows.start), pa.array(np.diff(offs)[rows]), pa.array(files, pa.binary())], names=[id_col, "n_bytes", "media"])

    return arrow_map(docs.select(id_col, text_col), run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_bytes long, media binary")


def analyse(table: DataFrame, *, id_col: str = "doc_id", with_pcm: bool = False) -> DataFrame:
    """Read a media table back: digests of payload and file, the codec, features of the decoded PCM and, if asked for, the PCM."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            media = batch.column(2)
            for rows in blocks(pc.binary_length(media).to_numpy(zero_copy_only=False), 1 << 20):
                n = rows.stop - rows.start
                stored = media.slice(rows.start, n).to_pylist()
                files = [read(x) for x in stored]
                sha = lambda items: pa.array([hashlib.sha256(x).hexdigest() for x in items], pa.string())
                pcm = decode(files)
                raw = [x.tobytes() for x in pcm]
                columns = [
                    batch.column(0).slice(rows.start, n), batch.column(1).slice(rows.start, n),
                    pa.array([len(p) for _, p in files], pa.int64()), sha(p for _, p in files), pa.array([zlib.crc32(p[-UNIT:]) for _, p in files], pa.int64()),
                    pa.array([len(x) for x in stored], pa.int64()), sha(stored),
                    pa.array([f"codec={c};{features(x)}" for (c, _), x in zip(files, pcm, strict=True)], pa.string()), sha(raw),
                ]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(raw, pa.binary())] if with_pcm else columns, names=names)

    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm_sha256"] + ["pcm"] * with_pcm
    kind = table.schema[id_col].dataType.simpleString()
    return arrow_map(table.select(id_col, "n_bytes", "media"), run, f"{id_col} {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_sha256 string" + ", pcm binary" * with_pcm)


def media_column(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_pcm: bool = False) -> DataFrame:
    """Store every text as telephony audio in the shared folder, then read the stored bytes back, describe them and, if asked for, give their resampled PCM."""
    return analyse(materialise(store(docs, id_col=id_col, text_col=text_col), "media", "zstd"), id_col=id_col, with_pcm=with_pcm)
