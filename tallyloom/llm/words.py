"""Words of whole batches of texts, without a loop over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the place of each word of each text among them, and words per text.

    A-Z are lower-cased; words are runs of anything but blank and 0x09-0x0D. Null counts as empty.
    """
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = parts.flatten().dictionary_encode()
    index = flat.indices.to_numpy(zero_copy_only=False)
    ends = parts.offsets.to_numpy()
    ends = ends - ends[0]
    empty = pc.index(flat.dictionary, "").as_py()
    if empty < 0:
        return flat.dictionary, index, np.diff(ends)
    full = index != empty
    before = np.concatenate([[0], np.cumsum(full)])
    return flat.dictionary, index[full], np.diff(before[ends])


def hash_words(vocabulary: pa.Array) -> np.ndarray:
    """64 bits of each word."""
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in vocabulary.to_pylist()), np.uint64, len(vocabulary))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _P1
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Each text's set of hashed n-word shingles, sorted; a text with fewer words is one shingle, one without words has none."""
    vocabulary, index, counts = split_words(texts)
    words = hash_words(vocabulary)[index]
    hashed = mix(words + _P2)
    for j in range(1, n):
        hashed[:-j or None] = mix(hashed[:-j or None] * _P2 + words[j:])
    out, at = [], 0
    for c in counts.tolist():
        if c >= n:
            out.append(np.unique(hashed[at:at + c - n + 1]))
        elif c:
            h = mix(words[at:at + 1] + _P2)
            for j in range(1, c):
                h = mix(h * _P2 + words[at + j:at + j + 1])
            out.append(h)
        else:
            out.append(np.empty(0, np.uint64))
        at += c
    return out


def regroup(batches, column: int, size: int):
    """The same rows in batches whose texts have about ``size`` bytes together, one text at least."""
    held, held_bytes = [], 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total, at = np.concatenate([[0], np.cumsum(lengths)]), 0
        while at < batch.num_rows:
            to = max(at + (not held), int(np.searchsorted(total, total[at] + size - held_bytes, "right")) - 1)
            if to > at:
                held.append(batch.slice(at, to - at))
                held_bytes += int(total[to] - total[at])
            if to < batch.num_rows:
                yield pa.concat_batches(held)
                held, held_bytes = [], 0
            at = to
    if held:
        yield pa.concat_batches(held)
