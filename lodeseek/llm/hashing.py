"""Word hashes as numpy arrays."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words a task remembers.
KNOWN_WORDS = 200_000
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit mixing of each element."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of words; a bounded memory of the common ones."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, words: list[str]) -> np.ndarray:
        known = self.known
        new = set(words).difference(known)
        if new:
            if len(known) + len(new) > KNOWN_WORDS:
                known.clear()
                new = set(words)
            digest = xxhash.xxh3_64_intdigest
            for w in new:
                known[w] = digest(w.encode("utf-8", "surrogatepass"))
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


#: Bytes hashed at once; longer words take the other function.
PART = 1 << 16
_BASE = np.uint64(0xD1342543DE82EF95)
_POWERS = np.r_[np.uint64(1), np.multiply.accumulate(np.full(PART, _BASE))]
_INVERSE = np.r_[np.uint64(1), np.multiply.accumulate(np.full(PART, np.uint64(pow(int(_BASE), -1, 1 << 64))))]


def byte_words(text: str | None) -> bytes:
    """The words of a text (runs of non-space in the contracts' sense) in UTF-8, one space between them."""
    return b" ".join(text.encode("utf-8", "surrogatepass").split()) if text else b""


def byte_hashes(data: bytes) -> np.ndarray:
    """64-bit hash of each word of :func:`byte_words`: differences of a running polynomial over the bytes."""
    raw, out, at = np.frombuffer(data, np.uint8), [], 0
    while at < len(raw):
        stop = min(len(raw), at + PART)
        if stop < len(raw) or stop - at == PART:
            cut = data.rfind(b" ", at, stop)
            if cut < 0:  # one word fills the part
                cut = data.find(b" ", stop)
                stop = len(raw) if cut < 0 else cut
                out.append(mix(np.array([xxhash.xxh3_64_intdigest(data[at:stop])], np.uint64)))
                at = stop + 1
                continue
            stop = cut
        part = raw[at:stop]
        spaces = np.flatnonzero(part == 32)
        begin, end = np.r_[0, spaces + 1], np.r_[spaces, len(part)]
        sums = np.r_[np.uint64(0), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _POWERS[:len(part)])]
        out.append(mix((sums[end] - sums[begin]) * _INVERSE[begin] + (end - begin).astype(np.uint64)))
        at = stop + 1
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` word hashes; a shorter list is one run."""
    if len(words) == 0:
        return words
    k = min(n, len(words))
    out = np.full(len(words) - k + 1, np.uint64(k))
    for i in range(k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[i:len(words) - k + 1 + i])
    return out
