"""64-bit hashes of all words of many texts at once, with numpy."""

from __future__ import annotations

import numpy as np

#: Bytes handled at once, so few that the arrays used, some 30 times as large, stay near the processor.
PIECE = 1 << 18
_BASE = 0x9DDFEA08EB382D69
_INVERSE = pow(_BASE, -1, 1 << 64)

NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False
#: Letters and digits of ASCII, and all bytes of other characters.
ALNUM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


#: Powers up and down for each place of a piece and of a word that begins in it; for longer words they are made anew, and not kept.
_UP, _DOWN = (_powers(base, PIECE + (1 << 12)) for base in (_BASE, _INVERSE))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_piece(buf: bytes, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word: its bytes by powers of the base, from differences of one running sum."""
    b = np.frombuffer(buf, np.uint8)
    w = is_word[b]
    edges = np.flatnonzero(w[1:] != w[:-1]) + 1
    if len(w) and w[0]:
        edges = np.append(0, edges)
    if len(edges) % 2:
        edges = np.append(edges, len(b))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    up, down = (_UP, _DOWN) if len(b) <= len(_UP) else (_powers(_BASE, len(b)), _powers(_INVERSE, len(b)))
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b + np.uint64(1)) * up[: len(b)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def _pieces(blob: bytes, is_word: np.ndarray):
    """A long text in pieces that end between words."""
    begin = 0
    while begin < len(blob):
        end = min(begin + PIECE, len(blob))
        while end < len(blob) and is_word[blob[end]]:
            end += 1
        yield blob[begin:end]
        begin = end


def hash_words(blobs: list[bytes], is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes, one text after the other, and where each text's begin (one number more than texts)."""
    hashes, counts, group, size = [], np.zeros(len(blobs), np.int64), [], 0

    def flush() -> None:
        nonlocal group, size
        if group:
            found, starts = _hash_piece(b" ".join(blobs[i] for i in group) + b" ", is_word)
            ends = np.cumsum([len(blobs[i]) + 1 for i in group])
            counts[group] = np.diff(np.concatenate([[0], np.searchsorted(starts, ends)]))
            hashes.append(found)
        group, size = [], 0

    for i, blob in enumerate(blobs):
        if len(blob) > PIECE:
            flush()
            for piece in _pieces(blob, is_word):
                found, _ = _hash_piece(piece, is_word)
                hashes.append(found)
                counts[i] += len(found)
            continue
        if size + len(blob) > PIECE:
            flush()
        group.append(i)
        size += len(blob) + 1
    flush()
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(counts)])
