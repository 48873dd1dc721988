"""Words of a slice of texts as numbers: equal numbers are equal bytes, no hash
decides.  The words are ``[^\\x20\\x09-\\x0D]+``, which is how Python splits bytes."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np

from shopsight.llm._text import _SPACE, SLICE_BYTES


def pieces(data: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[bytes]:
    """The bytes of one text in pieces that cut no word, of at most ``limit`` bytes
    where the words allow."""
    at, size = 0, len(data)
    while size - at > limit:
        gaps = np.flatnonzero(_SPACE[data[at:at + limit]])
        if len(gaps):
            end = at + int(gaps[-1]) + 1
        else:  # one word that is longer than the limit
            end = at + limit
            while end < size and not _SPACE[data[end]]:
                end += 1
        yield data[at:end].tobytes()
        at = end
    yield data[at:].tobytes()


def number_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The number of each word, each text's first word (one entry more than texts)
    and the words by number."""
    seen: defaultdict[bytes, int] = defaultdict()
    seen.default_factory = seen.__len__
    parts, first = [np.zeros(0, np.int64)], np.zeros(len(offsets), np.int64)
    for k in range(len(offsets) - 1):
        total = 0
        for piece in pieces(data[offsets[k]:offsets[k + 1]]):
            found = piece.split()
            parts.append(np.fromiter(map(seen.__getitem__, found), np.int64, len(found)))
            total += len(found)
        first[k + 1] = first[k] + total
    return np.concatenate(parts), first, list(seen)
