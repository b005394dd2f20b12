"""Arrow and numpy helpers that measure whole texts inside a task.

Spark cuts the table into partitions and Arrow batches; these helpers cut a
batch further, so that a task's working memory depends on ``SLICE_BYTES`` and
the longest single text, never on the batch.  All of them treat a null text as
empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text",
                max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of the batches that hold about ``max_bytes`` of text
    each (at least one row; a single longer text stands alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes, dtype=np.int64) // max_bytes
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for start, end in zip(edges, edges[1:]):
            yield batch.slice(start, end - start)
        pa.default_memory_pool().release_unused()  # workers are kept between tasks


def plain(texts: pa.Array) -> pa.Array:
    """Texts without nulls, with 64-bit offsets, in buffers of their own: some
    string kernels misread a slice."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    own = not len(texts) or np.frombuffer(texts.buffers()[1], dtype=np.int64, count=texts.offset + 1)[texts.offset] == 0
    return texts if own and not texts.offset else texts.take(pa.array(np.arange(len(texts))))


def sums(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sum of ``values`` by owner 0..n-1, as int64."""
    return np.bincount(owner, weights=values, minlength=n).astype(np.int64)


def split_owners(lists: pa.LargeListArray) -> tuple[pa.Array, np.ndarray]:
    """The flat values of a list array and the row each belongs to."""
    offsets = lists.offsets.to_numpy()
    return lists.flatten(), np.repeat(np.arange(len(lists)), np.diff(offsets))


@dataclass
class Words:
    """The words of n texts, in order: ``[^\\x20\\x09-\\x0D]+``."""

    n: int
    values: pa.Array      # each word
    owner: np.ndarray     # its text
    ids: np.ndarray       # its number in the slice's dictionary
    dictionary: pa.Array

    @property
    def counts(self) -> np.ndarray:
        return np.bincount(self.owner, minlength=self.n)


def words_of(texts: pa.Array) -> Words:
    parts = pc.ascii_split_whitespace(plain(texts))
    if isinstance(parts, pa.ListArray):
        parts = parts.cast(pa.large_list(pa.large_string()))
    values, owner = split_owners(parts)
    full = pc.greater(pc.binary_length(values), 0)
    values, owner = values.filter(full), owner[full.to_numpy(zero_copy_only=False)]
    coded = values.dictionary_encode()
    return Words(len(texts), values, owner, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary)


def byte_counts(texts: pa.Array, classes: list[bytes]) -> list[np.ndarray]:
    """For each class of ASCII characters, how many of them each text has."""
    texts = plain(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0]: offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    edges = offsets - offsets[0]
    out = []
    for chars in classes:
        member = np.zeros(256, dtype=bool)
        member[list(chars)] = True
        running = np.concatenate([[0], np.cumsum(member[raw], dtype=np.int64)])
        out.append(running[edges[1:]] - running[edges[:-1]])
    return out


def line_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Per text: its lines (split at \\n) with a word, and those of them that
    equal an earlier line."""
    parts = pc.split_pattern(plain(texts), "\n")
    if isinstance(parts, pa.ListArray):
        parts = parts.cast(pa.large_list(pa.large_string()))
    lines, owner = split_owners(parts)
    full = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(lines)), 0).to_numpy(zero_copy_only=False)
    ids = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)[full]
    owner = owner[full]
    n = len(texts)
    lines_with_word = np.bincount(owner, minlength=n)
    width = int(ids.max()) + 1 if len(ids) else 1
    first = np.unique(owner * width + ids) // width
    return lines_with_word, lines_with_word - np.bincount(first, minlength=n)


def repeated_window_words(words: Words) -> np.ndarray:
    """Per text: words that lie in a 3-word window found twice or more in it."""
    ids, owner = words.ids, words.owner
    if len(ids) < 3:
        return np.zeros(words.n, dtype=np.int64)
    whole = owner[:-2] == owner[2:]
    at = np.flatnonzero(whole)
    width = int(ids.max()) + 1
    _, pair = np.unique(ids[at] * width + ids[at + 1], return_inverse=True)
    # (pair, third word), made dense, then told apart by text: no product here can pass 63 bits
    _, triple = np.unique(pair.astype(np.int64) * width + ids[at + 2], return_inverse=True)
    _, where, times = np.unique(owner[at] * (len(at) + 1) + triple, return_inverse=True, return_counts=True)
    hit = at[times[where] > 1]
    covered = np.zeros(len(ids), dtype=bool)
    for k in range(3):
        covered[hit + k] = True
    return np.bincount(owner[covered], minlength=words.n)
