"""64-bit hashes of all words and word shingles of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

#: Bytes hashed at once; a longer word is hashed on its own.
BLOCK = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: The same, but with all ASCII marks as gaps too.
_NO_LETTER = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_STEP = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTES = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(_STEP))
_BASE = 0xD1B54A32D192ED03  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW, _INV = _powers(_BASE, BLOCK + 1), _powers(_INVERSE, BLOCK + 1)


def _block(buf: np.ndarray, gaps: np.ndarray, heads: tuple[int, ...]) -> tuple[np.ndarray, ...]:
    """Starts and hashes of the words of at most BLOCK bytes, and of their first so many bytes: a polynomial hash by differences of prefix sums."""
    gap = np.ones(len(buf) + 2, bool)
    gap[1:-1] = gaps[buf]
    turn = gap[1:] != gap[:-1]
    at = np.flatnonzero(turn)
    starts, ends = at[::2], at[1::2]
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTES[buf] * _POW[: len(buf)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * _INV[starts] + (ends - starts).astype(np.uint64) * np.uint64(_STEP)
    out = [starts, mix(h)]
    for k in heads:  # 0 for words that are no longer
        end = np.minimum(starts + k, len(buf))
        head = mix((sums[end] - sums[starts]) * _INV[starts] + np.uint64(k * 0x51ED2701))
        out.append(np.where(ends - starts > k, head, np.uint64(0)))
    return tuple(out)


def word_hashes(data: bytes, gaps: np.ndarray = _SPACE, heads: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """Byte starts and hashes of all words (runs without gaps), and the hashes of their heads."""
    import xxhash

    buf = np.frombuffer(data, np.uint8)
    parts, i = [], 0
    while i < len(buf):
        end = min(i + BLOCK, len(buf))
        if end < len(buf) and not gaps[buf[end]]:
            cuts = np.flatnonzero(gaps[buf[i:end]])
            if len(cuts):
                end = i + int(cuts[-1]) + 1
            else:  # one word longer than a block
                while end < len(buf) and not gaps[buf[end]]:
                    more = np.flatnonzero(gaps[buf[end : end + BLOCK]])
                    end += int(more[0]) if len(more) else len(buf[end : end + BLOCK])
                parts.append((np.array([i]), np.array([xxhash.xxh64_intdigest(data[i:end])], np.uint64), *[np.zeros(1, np.uint64) for _ in heads]))
                i = end
                continue
        found = _block(buf[i:end], gaps, heads)
        parts.append((found[0] + i, *found[1:]))
        i = end
    if not parts:
        return (np.zeros(0, np.int64), *[np.zeros(0, np.uint64)] * (1 + len(heads)))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def letter_words(texts: list[str | None], heads: tuple[int, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    """([word hashes, head hashes, ...], first word of each text and the end); marks separate words too."""
    raw = [(t or "").encode().lower() for t in texts]
    at = np.cumsum([0] + [len(r) + 1 for r in raw])
    starts, *hashes = word_hashes(b"\n".join(raw), _NO_LETTER, heads)
    return hashes, np.searchsorted(starts, at)


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each lower-cased word, first word of each text and the end): A-Z only are lowered."""
    raw = [(t or "").encode().lower() for t in texts]
    at = np.cumsum([0] + [len(r) + 1 for r in raw])
    starts, hashes = word_hashes(b"\n".join(raw))
    return hashes, np.searchsorted(starts, at)


def shingle_sets(texts: list[str | None], size: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle."""
    h, cut = words_of(texts)
    k = np.uint64(_STEP)
    if len(h) >= size:
        s = h[: len(h) - size + 1].copy()
        for j in range(1, size):
            s = s * k + h[j : len(h) - size + 1 + j]
        s = mix(s)
    else:
        s = np.zeros(0, np.uint64)
    out = []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(s[a : b - size + 1]))
        elif b > a:
            x = b - a
            for v in h[a:b].tolist():
                x = (x * _STEP + v) & 0xFFFFFFFFFFFFFFFF
            out.append(mix(np.array([x], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
