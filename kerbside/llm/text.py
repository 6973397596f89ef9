"""Byte-level helpers shared by the text operators.

``bytes.split()`` and ``bytes.lower()`` work on exactly the ASCII white space
``[\\x20\\x09-\\x0D]`` and on ``A-Z``, which is what the operators' contracts name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_SEED = 0x5EED_0DD5
_RNG = np.random.default_rng(_SEED)
#: A random 64-bit value for each byte.
BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
#: An odd base, so that it has an inverse modulo 2**64.
BASE = int(_RNG.integers(2**62, 2**63)) | 1
_INVERSE = pow(BASE, -1, 2**64)
_powers = np.ones(1, U64)
_inverse_powers = np.ones(1, U64)


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n; kept and grown by doubling."""
    global _powers, _inverse_powers
    while len(_powers) < n:
        m = len(_powers)
        _powers = np.concatenate([_powers, _powers * U64(pow(BASE, m, 2**64))])
        _inverse_powers = np.concatenate([_inverse_powers, _inverse_powers * U64(pow(_INVERSE, m, 2**64))])
    return _powers, _inverse_powers


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def words_of(text: str | None) -> list[bytes]:
    """The runs of anything but ASCII white space."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


#: Words, and bytes, hashed at a time: the tables of powers stay small whatever the text.
_WORDS_AT_A_TIME, _BYTES_AT_A_TIME = 20_000, 1 << 18


def _spans(items: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Prefix sums over the items joined by a space, inverse powers, and where items start and end."""
    data = np.frombuffer(b" ".join(items), np.uint8)
    lengths = np.fromiter(map(len, items), np.int64, len(items))
    ends = np.cumsum(lengths + 1) - 1  # one past the last byte of each item
    power, inverse = _powers_to(len(data) + 1)
    prefix = np.empty(len(data) + 1, U64)
    prefix[0] = 0
    np.cumsum(BYTE_VALUE[data] * power[: len(data)], out=prefix[1:])
    return prefix, inverse, ends - lengths, ends


def window_hashes(words: list[bytes], size: int) -> np.ndarray:
    """64-bit hashes of every ``size`` consecutive words, in order (empty if there are fewer).

    The words are joined by one space, a polynomial prefix sum is taken over the
    bytes, and each window is a difference of two prefix sums brought to one
    origin: linear in the text, whatever the window. Long texts go in overlapping pieces.
    """
    windows = len(words) - size + 1
    if windows <= 0:
        return np.empty(0, U64)
    out = []
    for at in range(0, windows, _WORDS_AT_A_TIME):
        prefix, inverse, starts, ends = _spans(words[at : at + _WORDS_AT_A_TIME + size - 1])
        lo, hi = starts[: len(starts) - size + 1], ends[size - 1 :]
        out.append(mix64((prefix[hi] - prefix[lo]) * inverse[lo] + (hi - lo).astype(U64)))
    return np.concatenate(out)


def hash_bytes(items: list[bytes]) -> np.ndarray:
    """64-bit hashes of byte strings."""
    out, part, size = [np.empty(0, U64)], [], 0
    for x in [*items, None]:
        if part and (x is None or size + len(x) > _BYTES_AT_A_TIME):
            prefix, inverse, lo, hi = _spans(part)
            out.append(mix64((prefix[hi] - prefix[lo]) * inverse[lo] + (hi - lo).astype(U64)))
            part, size = [], 0
        if x is not None:
            part.append(x)
            size += len(x) + 1
    return np.concatenate(out)


def slices(batches, rows: int = 500, size: int = 4 << 20):
    """The batches in slices of at most ``rows`` rows and about ``size`` bytes of text, so that few texts are Python
    objects at a time; a longer text is a slice of its own."""
    for b in batches:
        weight = np.zeros(b.num_rows, np.int64)
        for c in b.columns:
            if pa.types.is_string(c.type) or pa.types.is_binary(c.type):
                weight += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(weight), 0
        while at < b.num_rows:
            most = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right"))
            stop = min(max(most, at + 1), at + rows)
            yield b.slice(at, min(stop, b.num_rows) - at)
            at = stop


def free(name: str, columns: list[str]) -> str:
    """``name``, or the name with underscores before it that no column has (whatever its case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
