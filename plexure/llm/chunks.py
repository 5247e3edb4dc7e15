"""Splitting texts for byte-level tokenizers, with a bounded memory of what was encoded before.

A byte-level pattern never lets a match run from a non-blank into a blank, so a text may be cut before a
single space between two non-blanks, and each chunk encoded on its own gives the same ids. Arrow splits a
batch, numbers its distinct chunks and finds those that the worker remembers, a bounded number in an Arrow array; only new
ones become Python strings; numpy puts the ids of all chunks in order.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SAFE_CUT = re.compile(r"(?<=[!-~]) (?=[!-~])")
_ODD_BLANKS = r"  |\n | \n|[\x00\t\r\x0b\x0c\x1c-\x1f]|\x{85}|\x{a0}|\x{1680}|\x{180e}|[\x{2000}-\x{200f}]|\x{2028}|\x{2029}|\x{202f}|\x{205f}|\x{3000}|\x{feff}"
#: A Latin letter, marks, and a space: the pattern always parts the marks from the word. They become a part of their own, after NUL.
_TAIL = r"([A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}])([.,;:!?$%&*#]+) "
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def parts_of(texts: pa.Array) -> pa.ListArray:
    """Lists of parts of each text, cut only where no match of the pattern can cross. A space stands before each part but the first and those that begin with NUL, which is not in the text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.split_pattern(pc.replace_substring_regex(texts, _TAIL, "\\1 \x00\\2 "), " ")
    odd = np.flatnonzero(pc.match_substring_regex(texts, _ODD_BLANKS).to_numpy(zero_copy_only=False))
    if not len(odd):
        return lists
    other = pa.array([_SAFE_CUT.split(t) if "\0" not in t else [t] for t in texts.take(pa.array(odd)).to_pylist()], lists.type)
    order = np.arange(len(texts))
    order[odd] = len(texts) + np.arange(len(odd))
    return pa.concat_arrays([lists, other]).take(pa.array(order))


def split(find: Callable[[str], list[str]], chunk: str) -> list[str]:
    """The matches of the pattern in a chunk; those of a Latin word with trailing marks without the pattern."""
    head = 1 if chunk[0] == " " else 0
    core = chunk.rstrip(_MARKS)
    word = core[head:]
    if word.isalpha() and (word.isascii() or max(word) < "\u0250"):
        return [core] if len(core) == len(chunk) else [core, chunk[len(core) :]]
    return find(chunk)


#: Takes chunks, gives all their ids in order and the number of ids of each.
EncodeChunks = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


class ChunkEncoder:
    """Encodes texts to ids through ``encode_chunks``. Chunks are remembered by what follows their space; when more
    than ``most`` are known, those of the batch at hand are kept and the others forgotten."""

    def __init__(self, encode_chunks: EncodeChunks, most: int = 1_000_000) -> None:
        self.encode_chunks = encode_chunks
        self.most = most
        self._forget()

    def _forget(self) -> None:
        self.words = pa.array([], pa.large_string())
        self.flat, self.start, self.size = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _known(self, words: pa.Array) -> np.ndarray:
        """The places of the words in ``start`` and ``size``; new ones are encoded."""
        at = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = words.take(pa.array(missing))
            ids, size = self.encode_chunks([w[1:] if w[:1] == "\0" else " " + w for w in new.to_pylist()])
            first = len(self.start)
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.flat = np.concatenate([self.flat, ids])
            at[missing] = first + np.arange(len(new))
            self.words = pa.concat_arrays([self.words, new])
        return at

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and where each text's end; null is the empty text."""
        collecting = gc.isenabled()
        gc.disable()  # many small objects, no cycles
        try:
            return self._encode(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = parts_of(texts)
        at = lists.offsets.to_numpy()
        coded = lists.values.slice(int(at[0]), int(at[-1] - at[0])).dictionary_encode()
        at = at - at[0]
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        words = coded.dictionary
        firsts = words.take(pa.array(codes[at[:-1]])).to_pylist()  # these have no space before them
        alone, alone_size = self.encode_chunks(firsts)
        place = self._known(words)
        start = np.concatenate([self.start[place], len(self.flat) + np.cumsum(alone_size) - alone_size])
        size = np.concatenate([self.size[place], alone_size])
        flat = np.concatenate([self.flat, alone])
        codes[at[:-1]] = len(words) + np.arange(len(firsts))
        count = size[codes]
        ends = np.cumsum(count)
        out = flat[np.repeat(start[codes] - (ends - count), count) + np.arange(int(ends[-1]))]
        if len(self.words) > self.most:
            keep = self.flat, self.start[place], self.size[place]
            self._forget()
            count_ = keep[2]
            last = np.cumsum(count_)
            self.flat = keep[0][np.repeat(keep[1] - (last - count_), count_) + np.arange(int(last[-1]))]
            self.start, self.size = last - count_, count_
            self.words = words
        return out, ends[at[1:] - 1]
