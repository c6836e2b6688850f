"""Vectorised hashes of words and of runs of words, over many texts at once. All sums are modulo 2^64."""

from __future__ import annotations

import numpy as np

from barline.llm.common import FOLD

U = np.uint64
#: Odd factors of the polynomials; any odd numbers serve, but results are only comparable under the same ones.
BYTE_FACTOR, RUN_FACTOR, SECOND_FACTOR = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93), U(0xC2B2AE3D27D4EB4F)
HIGHEST = U(2**64 - 1)
#: Bytes hashed at a time, so that long texts need no long tables.
CHUNK = 1 << 21

#: White space that ends a word: blank and \\x09-\\x0D.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(factor: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """factor^i and factor^-i for i below n."""
    held = _powers.get(int(factor))
    if held is None or len(held[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(int(factor), -1, 2**64)
        up, down = np.full(size, factor, U), np.full(size, U(inverse), U)
        up[0] = down[0] = 1
        held = np.cumprod(up), np.cumprod(down)
        if size <= CHUNK + 1:
            _powers[int(factor)] = held
    return held


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over the whole number."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def hashed_words(texts: list[bytes | None], fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of all texts in order, and the place where each text's words begin (with the end as the last).

    fold: words of lower-cased letters and digits, else whatever stands between white space."""
    joined = b"\n".join(t or b"" for t in texts)
    data = np.frombuffer(joined.translate(FOLD) if fold else joined, np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~SPACE[data]
    edges = np.diff(inside)
    starts, stops = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    out = np.empty(len(starts), U)
    at = 0
    while at < len(starts):
        upto = max(at + 1, int(np.searchsorted(stops, starts[at] + CHUNK, "right")))
        low, high = int(starts[at]), int(stops[upto - 1])
        up, down = _tables(BYTE_FACTOR, high - low + 1)
        sums = np.zeros(high - low + 1, U)
        np.cumsum((data[low:high].astype(U) + U(1)) * up[:high - low], out=sums[1:])
        out[at:upto] = (sums[stops[at:upto] - low] - sums[starts[at:upto] - low]) * down[starts[at:upto] - low]
        at = upto
    begins = np.cumsum([0] + [len(t or b"") + 1 for t in texts])
    return mixed(out), np.searchsorted(starts, begins)


def run_hashes(words: np.ndarray, n: int, factor: np.uint64 = RUN_FACTOR) -> np.ndarray:
    """Hash of the n words from each place on (the last n - 1 places have none)."""
    if len(words) < n:
        return np.zeros(0, U)
    total = np.zeros(len(words) - n + 1, U)
    for i in range(n):
        total *= factor
        total += words[i:len(words) - n + 1 + i]
    return mixed(total)


def long_run_hashes(words: np.ndarray, n: int, factor: np.uint64) -> np.ndarray:
    """As run_hashes, by differences of prefix sums: the cost doesn't grow with n."""
    if len(words) < n:
        return np.zeros(0, U)
    out = np.empty(len(words) - n + 1, U)
    for at in range(0, len(out), CHUNK - n):
        part = words[at:at + CHUNK]
        up, down = _tables(factor, len(part) + 1)
        sums = np.zeros(len(part) + 1, U)
        np.cumsum(part * up[:len(part)], out=sums[1:])
        got = (sums[n:] - sums[:-n]) * down[:len(part) - n + 1]
        out[at:at + len(got)] = got
    return mixed(out)


def sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick (np.minimum or np.maximum) over each `width` consecutive values, in three passes over the values."""
    n = len(values)
    if n < width:
        return values[:0]
    blocks = -(-n // width)
    padded = np.empty(blocks * width, values.dtype)
    padded[:n], padded[n:] = values, values[-1]
    square = padded.reshape(blocks, width)
    ahead = pick.accumulate(square, axis=1).ravel()
    behind = pick.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(behind[:n - width + 1], ahead[width - 1:n])
