"""Sets of hashed word shingles, for whole batches of texts at once."""

from __future__ import annotations

import numpy as np

WORDS = 5
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.default_rng(20240527)
_BYTE = _rng.integers(0, 1 << 64, 256, np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _rng.integers(0, 1 << 64, WORDS, np.uint64) | np.uint64(1)
_SHORT = _rng.integers(0, 1 << 64, WORDS, np.uint64)
_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(2 * n, _STEP, np.uint64))])
    return _powers


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """The distinct hashes (sorted uint64) of each text's word shingles.

    Words are runs of code points other than U+0020 and U+0009 to U+000D, with
    A-Z lower-cased. A text of fewer words than a shingle has one, of all its
    words; without words, or null, none.
    """
    datas = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    data = _LOWER[np.frombuffer(b" ".join([*datas, b""]), np.uint8)]
    none = np.empty(0, np.uint64)
    inner = ~_WHITE[data]
    starts = np.flatnonzero(inner & ~np.concatenate([[False], inner[:-1]]))
    if not len(starts):
        return [none] * len(texts)
    keep = np.flatnonzero(inner)
    word = np.cumsum(np.concatenate([[False], ~inner[:-1] & inner[1:]]) if not inner[0] else
                     np.concatenate([[True], ~inner[:-1] & inner[1:]]))[keep] - 1
    place = keep - starts[word]
    values = _BYTE[data[keep]] * _power(int(place.max()) + 1)[place]
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    hashes = mix(np.add.reduceat(values, first))
    ends = np.cumsum([len(d) + 1 for d in datas])
    cut = np.searchsorted(starts, ends)  # words before the end of each text
    n_words = np.diff(cut, prepend=0)
    padded = np.concatenate([hashes, np.zeros(words, np.uint64)])
    joined = np.zeros(len(hashes), np.uint64)
    for j in range(words):
        joined += padded[j:j + len(hashes)] * _PLACE[j]
    joined = mix(joined)
    out = []
    for end, n in zip(cut.tolist(), n_words.tolist()):
        if n >= words:
            out.append(np.unique(joined[end - n:end - words + 1]))
        elif n:
            own = hashes[end - n:end]
            out.append(mix((own * _PLACE[:n]).sum(keepdims=True, dtype=np.uint64) + _SHORT[n]))
        else:
            out.append(none)
    return out
