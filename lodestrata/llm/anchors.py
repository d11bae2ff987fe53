"""Content-chosen anchors: where windows that may repeat meet.

A window of W tokens (bytes or words) occurs twice only if the q-gram that has the least hash in it does.  Those q-grams, the
anchors, are about 2 / (W - q + 2) of all positions; only they are shuffled, and only those that occur twice go on.  The hashes here
choose and deal anchors, no more: two q-grams of one hash share a bucket, in which contents are compared.
"""

from __future__ import annotations

import hashlib

import numpy as np

_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 2**64)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(32)
_TABLE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)  # a fixed random code for each byte
_CHUNK = 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S)) * _M1
    x = (x ^ (x >> _S)) * _M2
    return x ^ (x >> _S)


def _powers(base: int, n: int, cache: dict = {}) -> np.ndarray:
    got = cache.get(base)
    if got is None or len(got) < n:
        size = max(n, _CHUNK * 2)
        full = np.full(size, base, np.uint64)
        full[0] = 1
        got = cache[base] = np.multiply.accumulate(full)
    return got[:n]


def _prefix(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * _powers(_R, len(data)), out=out[1:])
    return out


def gram_hashes(data: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of every q bytes in a row."""
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    p = _prefix(data)
    return mix((p[q:] - p[:n]) * _powers(_RINV, n))


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every `width` neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        x = pick(x[:-have], x[have:])
        have *= 2
    return pick(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def pick_anchors(hashes: np.ndarray, valid: np.ndarray, width: int) -> np.ndarray:
    """Positions that have the least hash in some valid window; hashes: of q-grams, valid: of windows, width: q-grams in a window."""
    n = len(valid)
    if not n or not valid.any():
        return np.zeros(0, np.int64)
    least = np.where(valid, _sliding(hashes[: n + width - 1], width, np.minimum), np.uint64(0))
    pad = np.zeros(width - 1, np.uint64)
    best = _sliding(np.concatenate([pad, least, pad]), width, np.maximum)
    return np.flatnonzero((best == hashes[: len(best)]) & (best > 0))


def window_starts(ends: np.ndarray, starts: np.ndarray, n: int, width: int) -> np.ndarray:
    """Which of n positions start a window of `width` tokens within its document."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, np.maximum(starts, ends - width + 1), 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:n]) == 0


def byte_anchors(data: np.ndarray, offsets: np.ndarray, window: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of all texts that lie end to end in data: positions and hashes. Works piece by piece, within the cache."""
    valid = window_starts(offsets[1:], offsets[:-1], len(data), window)
    width, left, at, out = window - q + 1, window - q, [], []
    for s in range(0, len(data), _CHUNK):
        ok = valid[s : s + _CHUNK]
        ok = ok[: max(0, min(len(ok), len(data) - s - window + 1))]
        if not ok.any():
            continue
        base = max(0, s - left)
        prefix = _prefix(data[base : s + len(ok) + 2 * window])
        h = mix((prefix[s - base + q :] - prefix[s - base : -q]) * _powers(_RINV, len(prefix) - q)[s - base :]) | np.uint64(1)
        p = pick_anchors(h, ok, width)
        at.append(p + s)
        out.append(h[p])
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, first = np.unique(np.concatenate(at), return_index=True)
    return at, np.concatenate(out)[first]


def digests(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """96 bits of BLAKE2b of each range of bytes, as rows of three uint32: ranges of one digest are taken to be equal."""
    view, digest = memoryview(data), hashlib.blake2b
    return np.frombuffer(b"".join([digest(view[a:b], digest_size=12).digest() for a, b in zip(starts.tolist(), ends.tolist())]), np.uint32).reshape(-1, 3)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True


def word_edges(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Texts end to end, starts and ends of their words [^\\x20\\x09-\\x0D]+, and where each text's words begin among them (one more at the end)."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    joined = b"\n".join(texts) + b"\n"
    edge = np.diff(_SPACE[np.frombuffer(joined, np.uint8)].astype(np.int8), prepend=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    return joined, starts, ends, np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]))


def hash_words(joined: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    data, out, first = np.frombuffer(joined, np.uint8), np.empty(len(starts), np.uint64), 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + _CHUNK, "right")))
        base = starts[first]
        p = _prefix(data[base : ends[last - 1]])
        a, b = starts[first:last] - base, ends[first:last] - base
        out[first:last] = mix((p[b] - p[a]) * _powers(_RINV, len(p))[a])
        first = last
    return out


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and where each text's words begin among them (one more at the end)."""
    joined, starts, ends, offsets = word_edges(texts)
    return hash_words(joined, starts, ends), offsets


def word_anchors(words: np.ndarray, offsets: np.ndarray, window: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(words) - q + 1
    if len(words) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(q):
        h = h * np.uint64(_R) + words[j : j + n]
    h = mix(h) | np.uint64(1)
    valid = window_starts(offsets[1:], offsets[:-1], len(words), window)[: len(words) - window + 1]
    p = pick_anchors(h, valid, window - q + 1)
    return p, h[p]
