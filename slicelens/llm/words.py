"""Words of many texts at once, as numpy arrays over their joined bytes.

A word's hash is the polynomial of its bytes modulo 2^64, taken from running
sums, so every word and every prefix of a word costs a few array steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PIECE = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Bytes of a word by the blank rule: anything but space and tab to carriage return.
UNBLANK = np.ones(256, bool)
UNBLANK[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of a word by the letter rule: ASCII letters and digits, and all of UTF-8's long characters.
LETTERS = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def _cut(text: str, size: int) -> int:
    """Where to cut a long text: after a blank, the last one before ``size`` if it lies in the second half."""
    at = max(text.rfind(" ", size // 2, size), text.rfind("\n", size // 2, size))
    if at < 0:
        later = [i for i in (text.find(" ", size), text.find("\n", size)) if i >= 0]
        at = min(later, default=len(text) - 1)
    return at + 1


def pieces(texts: list[str | None], size: int = PIECE) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Cut a batch into groups of about ``size`` characters: owners (row numbers) and pieces.

    Only texts beyond ``size`` are cut, and no word ever is; owners never go
    down. Every character is in exactly one piece.
    """
    owners, out, held = [], [], 0
    for row, text in enumerate(texts):
        text = text or ""
        while True:
            at = _cut(text, size) if len(text) > size else len(text)
            piece, text = text[:at], text[at:]
            if held and held + len(piece) > size:
                yield np.array(owners), out
                owners, out, held = [], [], 0
            owners.append(row)
            out.append(piece)
            held += len(piece)
            if not text:
                break
    if out:
        yield np.array(owners), out


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes with a line feed after each text, and where each text starts (one more at the end)."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    starts = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=starts[1:])
    return np.frombuffer(b"\n".join([*raw, b""]), np.uint8), starts


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return data + ((data >= 65) & (data <= 90)) * np.uint8(32)


def spans(data: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that ``kind`` marks; the last byte must not be one."""
    inside = kind[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edges = np.concatenate(([0], edges))
    return edges[0::2], edges[1::2]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_P, _INVERSE)):
            steps = np.full(max(n, PIECE + (PIECE >> 2)), base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


class Sums:
    """Running polynomial sums of some bytes; ``hashes`` of any of their spans."""

    def __init__(self, data: np.ndarray):
        up, self.down = _power(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts])


def runs(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of every ``length`` hashes in a row."""
    n = len(hashes) - length + 1
    if n <= 0:
        return hashes[:0]
    total = np.zeros(n, np.uint64)
    for i in range(length):
        total = total * _P + hashes[i : i + n]
    return mixed(total)


def shingle_sets(texts: list[str | None], length: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``length``-word shingles of each whole text.

    Words follow the blank rule, A to Z lowered. A text with fewer words has
    one shingle, all its words; a text without words has none.
    """
    held: list[list[np.ndarray]] = [[] for _ in texts]
    for owners, part in pieces(texts):
        data, starts = joined(part)
        data = lower_ascii(data)
        s, e = spans(data, UNBLANK)
        h = Sums(data).hashes(s, e)
        ends = np.searchsorted(s, starts[1:])
        for owner, own in zip(owners, np.split(h, ends[:-1]), strict=True):
            held[owner].append(own)
    out = []
    for parts in held:
        h = parts[0] if len(parts) == 1 else np.concatenate(parts)
        out.append(np.unique(runs(h, min(length, len(h)))) if len(h) else h)
    return out
