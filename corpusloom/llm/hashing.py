"""64-bit hashes of words and word shingles, computed over whole byte arrays at once."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Odd base of the running polynomial and its inverse modulo 2**64; constants of a well-known 64-bit finaliser.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: Bytes that are hashed at once; longer input goes in chunks that end at white space.
CHUNK_BYTES = 1 << 20
SLICE_BYTES = 4 << 20

SPACE = np.zeros(256, np.uint8)
SPACE[[0x20, *range(0x09, 0x0E)]] = 1
_GAP = re.compile(rb"[ \t-\r]")
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + 4096)
        for name, base in (("up", BASE), ("down", INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def run_hashes(data: bytes, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, hash) of data's maximal runs of bytes of one class; class 0 separates and must hold white space."""
    starts, lengths, hashes = [], [], []
    at = 0
    while at < len(data):
        end = len(data)
        if end - at > CHUNK_BYTES:
            gap = _GAP.search(data, at + CHUNK_BYTES)
            end = gap.start() + 1 if gap else end
        a = np.frombuffer(data, np.uint8, end - at, at)
        up, down = _powers(len(a) + 1)
        c = classes[a]
        edge = np.flatnonzero(np.r_[True, c[1:] != c[:-1], True])
        s, e = edge[:-1], edge[1:]
        real = c[s] > 0
        s, e = s[real], e[real]
        sums = np.zeros(len(a) + 1, np.uint64)
        np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)], out=sums[1:])
        h = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        starts.append(s + at)
        lengths.append(e - s)
        hashes.append(h)
        at = end
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(starts), np.concatenate(lengths), np.concatenate(hashes)


def shingle_sets(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's k-word shingles; a text of fewer words has its whole sequence as one.

    Words are runs of anything but the six ASCII white-space characters, lower-cased in ASCII.
    """
    raw = [t.encode("utf-8", "surrogatepass").lower() if t else b"" for t in texts]
    offsets = np.cumsum([0, *(len(r) + 1 for r in raw)])
    starts, _, w = run_hashes(b"\n".join(raw) + b"\n", 1 - SPACE)
    bounds = np.searchsorted(starts, offsets)
    chain = mix(w)
    whole = max(0, len(w) - k + 1)
    for j in range(1, k):
        chain[:whole] = mix(chain[:whole] * np.uint64(BASE) + w[j : j + whole])
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= k:
            yield np.unique(chain[a : b - k + 1])
        elif b > a:
            h = mix(w[a : a + 1])
            for j in range(a + 1, b):
                h = mix(h * np.uint64(BASE) + w[j : j + 1])
            yield h
        else:
            yield np.empty(0, np.uint64)


def slices(batch: pa.RecordBatch, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of about size bytes, of one row at least."""
    rows = max(1, int(batch.num_rows * size / max(batch.nbytes, size)))
    for first in range(0, batch.num_rows, rows):
        yield batch.slice(first, rows)
