"""Words of texts as 64-bit hashes, batch by batch."""

from __future__ import annotations

import numpy as np
import xxhash

from witspark.llm.common import per_worker

#: Words that a worker remembers with their hashes.
MEMO = 200_000
MEMO_BYTES = 64


class _Hashes(dict):
    def __missing__(self, word):
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= MEMO_BYTES:
            if len(self) >= MEMO:
                self.clear()
            self[word] = value
        return value


def word_hashes(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words `[^\\x20\\x09-\\x0D]+` of all texts, A-Z as a-z, and words per text.

    bytes.lower and bytes.split know exactly these letters and separators.
    """

    known = per_worker("word-hashes", _Hashes)
    words = [body.lower().split() for body in bodies]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = [w for own in words for w in own]
    return np.fromiter(map(known.__getitem__, flat), np.uint64, len(flat)), sizes


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
