"""Token counts of whole texts by a SentencePiece BPE model, without shuffling a pre-token.

Method: a map-side lookup in two tiers. A text is cut into pre-tokens at borders that no piece of the vocabulary
crosses: before a blank that follows another character, and around line ends. Each task counts its distinct
pre-tokens into a bounded summary of frequent ones, a tree of merges brings the summaries together, and
the lengths of the ``most`` frequent are broadcast as one compact table. Then each task looks its distinct
pre-tokens up there, the others in its worker's cache, and has the library encode what neither holds. A text's count is
the sum over its pre-tokens, so no pre-token leaves its task.

The summaries subtract what they drop (Misra and Gries), so a word of more than a share 1 / (4 * most) of a task's words is in its
summary. They decide what is looked up where, never a count.

Memory: a batch of over 4 MB holds one text, which is taken in stretches. Pre-tokens of over ``LONG`` characters are not kept. They are cut wherever no piece holds the two characters side
by side; what is still longer than a window goes through the library in windows. A window begins at a border of
the one before, and is taken over where both end the same token: its next token then stands beside that one in the
library's own result, and merges leave tokens alone exactly when they do so with each pair of neighbours (pieces of blanks alone share
one score; their runs are merged from the left, so that what follows a border does not depend on what is before it).

Defined results: null and empty texts have no tokens and no bytes. Control pieces in a text are ordinary text, as the
library has them. Rows are counted as they come, repeated ids and null ids too. A model whose pieces do cross such borders, or
share scores, is used on whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexure.llm.common import arrow_map, column, record, slices, texts_of, tree_depth

SPACE = "\u2581"  # as the library writes a blank
LONG, WINDOW, OVERLAP, STEP = 256, 1 << 16, 1 << 10, 1 << 20
_CUT = re.compile(r"(?<=[^ ])(?= )|(?<=\n)|(?=\n)")
_BORDER = re.compile(r"(?<=[^ \n]) |\n")


def pre_tokens(texts: pa.Array, lead: bool = True) -> pa.ListArray:
    """The pre-tokens of each text, some of them empty, which count nothing. lead: write out the blank that the library sets before a text."""
    led = texts = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), SPACE, " ")
    if lead:
        led = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))
        led = pc.if_else(pc.equal(pc.binary_length(texts), 0), pa.scalar("", pa.large_string()), led)
    marked = pc.replace_substring_regex(pc.replace_substring(led, "\n", "\x00\n\x00"), r"([^ ]) ", "\\1\x00 ")
    lists = pc.split_pattern(marked, "\x00")
    odd = np.flatnonzero(pc.match_substring(texts, "\x00").to_numpy(zero_copy_only=False))
    if not len(odd):
        return lists
    other = pa.array([_CUT.split(t) for t in led.take(pa.array(odd)).to_pylist()], lists.type)
    order = np.arange(len(texts))
    order[odd] = len(texts) + np.arange(len(odd))
    return pa.concat_arrays([lists, other]).take(pa.array(order))


class PieceCounter:
    """Numbers of tokens of pre-tokens, by the library's own encoding."""

    def __init__(self, path: str, window: int = WINDOW, overlap: int = OVERLAP) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.window, self.overlap = window, overlap
        ids = [i for i in range(self.model.get_piece_size()) if not (self.model.is_control(i) or self.model.is_byte(i) or self.model.is_unknown(i))]
        pieces = [self.model.id_to_piece(i) for i in ids]
        pairs = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        codes = sorted({ord(p[0]) << 32 | ord(p[1]) for p in pairs})
        self.pairs = np.array(codes, np.uint64)
        #: Whether pre-tokens may be counted one by one, and whether windows may be joined.
        self.cuts = not any("\n" in p or (p[0] != SPACE and p[1] == SPACE) for p in pairs) and self.model.normalize("a  \n b ") == f"{SPACE}a{SPACE * 2}\n{SPACE}b{SPACE}"
        scores = [self.model.get_score(i) for i, p in zip(ids, pieces, strict=True) if len(p) > 1 and p.strip(SPACE)]
        self.ranked = len(set(scores)) == len(scores)
        #: The tokens of a leading blank and a line end, which stand before each pre-token when it is encoded.
        self.before = len(self.model.encode("\n"))

    def _ids(self, words: list[str]) -> list[list[int]]:
        return [x[self.before :] for x in self.model.encode(["\n" + w for w in words], num_threads=1)]

    def _run(self, text: str) -> int:
        """Tokens of a long text without a sure border, window by window."""
        at = count = 0
        size = self.window
        held: list[int] | None = None  # ends of the last window's tokens from ``at`` on, as places of the text
        while True:
            ids = self._ids([text[at : at + size]])[0]
            length = [0 if self.model.is_byte(i) else len(self.model.id_to_piece(i)) for i in ids]
            if 0 in length or not self.ranked:
                return len(self._ids([text])[0])
            ends = (at + np.cumsum(length)).tolist()
            if held is not None:
                starts = dict(zip(ends, [at, *ends[:-1]], strict=True))
                same = next((k for k in range(len(held) - 1, 0, -1) if starts.get(held[k]) == held[k - 1]), None)
                if same is None:  # never seen: take both windows as one
                    return len(self._ids([text])[0])
                count += same + 1
                mine = ends[ends.index(held[same]) + 1 :]
            else:
                mine = ends
            if at + size >= len(text):
                return count + len(mine)
            # The next window begins at a border some way before this one's end.
            keep = next((k for k in range(len(mine) - 1, -1, -1) if mine[k] <= at + size - self.overlap), None)
            if keep is None:
                return len(self._ids([text])[0])
            count += keep + 1
            at, held = mine[keep], mine[keep + 1 :]

    def _long(self, word: str) -> int:
        """Tokens of a long pre-token: cut where no piece holds both characters, so that parts are counted alone."""
        text = word.replace(" ", SPACE)
        total, start, short = 0, 0, []
        for at in range(0, len(text), STEP):
            code = np.frombuffer(text[at : at + STEP + 1].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
            pair = code[:-1] << np.uint64(32) | code[1:]
            place = np.minimum(np.searchsorted(self.pairs, pair), max(len(self.pairs) - 1, 0))
            cuts = (np.flatnonzero(self.pairs[place] != pair) + at + 1).tolist()
            for cut in cuts if at + STEP < len(text) else [*cuts, len(text)]:
                if cut - start > self.window:
                    total += self._run(text[start:cut])
                else:
                    short.append(text[start:cut])
                start = cut
                if len(short) == 10_000:
                    total += sum(map(len, self._ids(short)))
                    short = []
        return total + sum(map(len, self._ids(short)))

    def counts(self, words: list[str]) -> list[int]:
        out = [len(x) for x in self._ids([w if len(w) <= LONG else "" for w in words])]
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self._long(w)
        return out


@cache
def counter(path: str) -> tuple[PieceCounter, dict[str, int]]:
    """One for each Python worker, with its cache."""
    return PieceCounter(path), {}


def _shrunk(counts: dict[str, int], most: int) -> dict[str, int]:
    """At most ``most`` words; the next count is taken from each, so that what stays is never too large."""
    if len(counts) <= most:
        return counts
    bar = np.partition(np.fromiter(counts.values(), np.int64, len(counts)), len(counts) - most - 1)[len(counts) - most - 1]
    return {w: int(c - bar) for w, c in counts.items() if c > bar}


def _add_words(known: dict[str, int], words: pa.Array) -> None:
    words = words.filter(pc.less_equal(pc.binary_length(words), 64)).value_counts()
    for w, c in zip(words.field(0).to_pylist(), words.field(1).to_pylist(), strict=True):
        known[w] = known.get(w, 0) + c


def frequent(docs: DataFrame, most: int) -> list[str]:
    """The pre-tokens that all texts hold most often, in code point order; ``most`` of them at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in slices(batches):
            text = column(batch, "text")
            # Of a very long text, what stands between borders, as below.
            long = batch.num_rows == 1 and text.nbytes > 4 * STEP
            parts = ([p] for p in stretches(text[0].as_py() or "") if len(p) <= 2 * STEP) if long else [text]
            for part in parts:
                _add_words(known, pre_tokens(pa.array(part) if long else part, not long).flatten())
            if len(known) > 16 * most:
                known = _shrunk(known, 4 * most)
        known = _shrunk(known, 4 * most)
        yield pa.RecordBatch.from_pydict({"words": pa.array([list(known)], pa.list_(pa.string())), "n": pa.array([list(known.values())], pa.list_(pa.int64()))})

    def add(known: dict[str, int], row) -> dict[str, int]:
        return both(known, dict(zip(row.words, row.n, strict=True)))

    def both(a: dict[str, int], b: dict[str, int]) -> dict[str, int]:
        out = dict(a)
        for w, c in b.items():
            out[w] = out.get(w, 0) + c
        return _shrunk(out, 4 * most)

    parts = arrow_map(docs.select("text"), run, "words array<string>, n array<long>").rdd
    known = parts.treeAggregate({}, add, both, tree_depth(parts))
    return sorted(sorted(known, key=lambda w: (-known[w], w))[:most])


class Table:
    """Lengths of the frequent pre-tokens: one Arrow array and a number for each. Arrow hashes it."""

    def __init__(self, words: list[str], size: list[int]) -> None:
        self.words, self.size = pa.array(words, pa.large_string()), np.array(size, np.int64)

    def find(self, words: pa.Array) -> np.ndarray:
        """The number of tokens of each word, -1 if it is not here."""
        at = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False)
        return np.where(at < 0, -1, self.size[at]) if len(self.size) else np.full(len(words), -1, np.int64)


def stretches(text: str) -> Iterator[str]:
    """A very long text, with its leading blank, in stretches of about ``STEP`` characters between borders; longer ones if there are none."""
    text, at = " " + text.replace(SPACE, " "), 0
    while at < len(text):
        found = _BORDER.search(text, at + STEP)
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


def _sums(lists: pa.ListArray, table: Table, count: Callable[[list[str]], list[int]], cache_: dict[str, int], most: int) -> np.ndarray:
    """The tokens of each text, by the table, then the cache, then the library."""
    offsets = lists.offsets.to_numpy()
    coded = lists.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).dictionary_encode()
    size = table.find(coded.dictionary)
    misses = np.flatnonzero(size < 0)
    if len(misses):
        words = coded.dictionary.take(pa.array(misses)).to_pylist()
        new = [w for w in words if w not in cache_]
        found = dict(zip(new, count(new), strict=True))
        size[misses] = [found[w] if w in found else cache_[w] for w in words]
        if len(cache_) + len(found) > most:
            cache_.clear()
        cache_.update((w, n) for w, n in found.items() if len(w) <= 64)
    upto = np.concatenate([[0], np.cumsum(size[coded.indices.to_numpy(zero_copy_only=False)])])
    at = offsets - offsets[0]
    return upto[at[1:]] - upto[at[:-1]]


def token_counts(docs: DataFrame, path: str, limit: int = 4096, most: int = 1 << 15, most_cached: int = 1 << 18) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``docs`` (doc_id, text).

    path: a ``.model`` file that every machine has. most: words in the broadcast table (about 2 MB). most_cached: words that a worker
    remembers besides; a full cache is emptied.
    """
    texts = texts_of(docs)
    here = PieceCounter(path)
    words = frequent(texts, most) if here.cuts else []
    given = docs.sparkSession.sparkContext.broadcast(Table(words, here.counts(words)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, known = counter(path)
        for batch in slices(batches):
            text = column(batch, "text")
            if pieces.cuts and batch.num_rows == 1 and text.nbytes > 4 * STEP:
                n = np.zeros(1, np.int64)
                for part in stretches(text[0].as_py() or ""):
                    if len(part) > 2 * STEP:
                        n += pieces.counts([part])
                    else:
                        n += _sums(pre_tokens(pa.array([part]), False), given.value, pieces.counts, known, most_cached)
            elif pieces.cuts:
                n = _sums(pre_tokens(text), given.value, pieces.counts, known, most_cached)
            else:
                n = np.array([len(pieces.model.encode(t or "")) for t in text.to_pylist()], np.int64)
            size = pc.fill_null(pc.binary_length(text), 0)
            yield record("doc_id:long n_bytes:long n_tokens:long", column(batch, "doc_id"), size, pa.array(n))

    out = arrow_map(texts, run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
