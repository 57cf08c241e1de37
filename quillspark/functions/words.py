"""tokenize() for whole batches: Arrow text in, terms with their counts out, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quillspark.functions.text import STOPWORDS

#: Text that is taken at a time; a longer single text is taken alone.
STEP_BYTES = 2 << 20
# letters and digits in lower case, 0 for all that parts words
_FOLD = np.zeros(256, np.uint8)
_FOLD[48:58] = np.arange(48, 58)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_STOP = pa.array(STOPWORDS)


def steps(batches: Iterator[pa.RecordBatch], text: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so much text, of one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right"))
            to = max(to, at + 1)
            yield batch.slice(at, to - at)
            at = to


def _raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and where each begins (one more at the end)."""
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    texts = texts.cast(pa.large_string())
    _, where, data = texts.buffers()
    begin = np.frombuffer(where, np.int64, len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return held[begin[0] : begin[-1]], begin - begin[0]


class Words:
    """The tokens of a slice of texts: each one's text and number in a dictionary of terms, stop words left out."""

    def __init__(self, texts: pa.Array):
        raw, begin = _raw(texts)
        folded = _FOLD[raw]
        if (raw >= 0xC4).any():
            # the two characters beyond ASCII whose lower case begins with a letter of it
            kelvin = (raw[:-2] == 0xE2) & (raw[1:-1] == 0x84) & (raw[2:] == 0xAA)
            if kelvin.any():
                raw, begin = _raw(pc.replace_substring(texts, "\u212a", "k"))
                folded = _FOLD[raw]
            folded[np.flatnonzero((raw[:-1] == 0xC4) & (raw[1:] == 0xB0))] = ord("i")
        inside = folded > 0
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        # no word goes on in the next text
        heads = begin[:-1][np.diff(begin) > 0]
        first[heads] = inside[heads]
        last[heads[heads > 0] - 1] = inside[heads[heads > 0] - 1]
        start = np.flatnonzero(first)
        size = np.flatnonzero(last) - start + 1
        inside[start[size == 1]] = False
        start, size = start[size > 1], size[size > 1]
        owner = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(start, begin)))
        ends = np.concatenate([[0], np.cumsum(size)])
        coded = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(folded[inside])).dictionary_encode()
        codes, self.terms = coded.indices.to_numpy(), coded.dictionary.cast(pa.string())
        use = ~pc.is_in(self.terms, _STOP).to_numpy(zero_copy_only=False)[codes] if len(codes) else np.zeros(0, bool)
        self.texts, self.codes, self.owner = len(texts), codes[use].astype(np.int64), owner[use]

    def lengths(self) -> np.ndarray:
        return np.bincount(self.owner, minlength=self.texts)

    def counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, term and count of each term of each text."""
        both, n = np.unique(self.owner * max(len(self.terms), 1) + self.codes, return_counts=True)
        return both // max(len(self.terms), 1), both % max(len(self.terms), 1), n
