"""Blocks of documents as numbered things, and compact payloads for what a block asks and is told."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


class Numbers(dict):
    """Number things as they first come."""

    def __missing__(self, key) -> int:
        self[key] = found = len(self)
        return found


def squeeze(data: bytes) -> bytes:
    """Length, compressed length and Zstandard frame."""
    packed = pa.Codec("zstd").compress(data, asbytes=True) if data else b""
    return len(data).to_bytes(8, "little") + len(packed).to_bytes(8, "little") + packed


def loosen(data: bytes, at: int) -> tuple[bytes, int]:
    """The data that begins at ``at``, and where the next begins."""
    size, held = (int.from_bytes(data[at + k:at + k + 8], "little") for k in (0, 8))
    end = at + 16 + held
    return (pa.Codec("zstd").decompress(data[at + 16:end], size, asbytes=True) if size else b""), end


def squeeze_planes(array: np.ndarray) -> bytes:
    """Whole numbers, their bytes by significance, compressed."""
    return squeeze(np.ascontiguousarray(array).view("u1").reshape(-1, array.itemsize).T.tobytes())


def loosen_planes(data: bytes, width: int = 4, at: int = 0) -> tuple[np.ndarray, int]:
    raw, at = loosen(data, at)
    return np.frombuffer(raw, "u1").reshape(width, -1).T.copy().view(f"<u{width}").ravel(), at


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each stretch, one stretch after the other."""
    ends = np.cumsum(sizes, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, int(starts.max(initial=0))) < 1 << 30 else np.int64
    places = np.repeat((starts - (ends - sizes)).astype(kind), sizes)
    places += np.arange(total, dtype=kind)
    return places
