"""Language of a text from averaged subword embeddings.

Method: the character n-grams of a text's words (and the words) are hashed into an embedding table; their
average goes through a linear softmax. Both are trained together by stochastic gradient descent in numpy.
Probabilities are calibrated by one temperature on documents kept back from training, and a prediction whose
calibrated probability falls under a threshold found there is marked ``rejected``.

Because the model is linear after the average, a word's share of the logits is one row; a text is the sum of its
words' rows. A batch of texts is parted into words and dictionary-encoded by Arrow; the n-grams of its distinct words
are hashed, looked up and summed by numpy, all words at once. Nothing is remembered between batches. A batch of over 4 MB
holds one text, which is taken in stretches between blanks; a longer word is taken in pieces that overlap by a gram, whose rows are added.

The model is fitted on at most ``most_docs`` labelled documents, those with the least hash of doc_id, and at most
``most_units`` units of them, dealt by turns over the languages and over the documents of each. A unit is a line, or
a piece of at most ``PIECE`` characters of a longer one. Units are drawn where the texts are read, about four times
``most_units`` / documents of each document by the least hashes of unit and place; only they reach the driver. These are
documented bounds of the fit; every text is scored whole.

Defined results: null text or one without a letter is ``und`` with score 0. So is every text if nothing could
be learned. Null labels are not learned; a language with a single document is learned like any other.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexure.llm.common import arrow_map, column, record, slices, small_crc, texts_of

BUCKETS, WIDTH, SIZES, PIECE = 1 << 15, 16, (1, 2, 3, 4), 1000
_STEP = np.uint32(0x01000193)
#: Characters of a stretch of a very long text, and the blanks that part words.
STRETCH = 1 << 20
_BLANK = re.compile("[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


@lru_cache(maxsize=1)
def _alphabetic() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    h = (h ^ (h >> np.uint32(12))) * np.uint32(0x297A2D39)
    return ((h ^ (h >> np.uint32(15))) % np.uint32(BUCKETS)).astype(np.int32)


def units(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each word, its borders included, and of the word; rows of places, and each word's first row.

    The letters of all words, in lower case, stand in one row of code points with a border before each and at the
    end. Column n of a place is the bucket of the gram of ``SIZES[n]`` points from there, the last column that of the
    word whose border stands there; ``BUCKETS`` where there is none. Words have no blanks.
    """
    codes = np.frombuffer(("\n" + "\n".join(words) + "\n").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    border = codes == 10
    keep = border | _alphabetic()[codes]
    codes, border = codes[keep], border[keep]
    codes = np.where(border, np.uint32(0), codes)
    at = np.flatnonzero(border)
    n, starts = len(codes) - 1, at[:-1]
    length = np.diff(at)  # of a word and the border before it
    left = np.repeat(at[1:], length) - np.arange(n)  # points to the next border
    some = np.repeat(length > 1, length)
    out = np.full((n, len(SIZES) + 1), BUCKETS, np.int32)
    h = np.zeros(n, np.uint32)
    padded = np.concatenate([codes, np.zeros(max(SIZES), np.uint32)])
    for size in range(1, max(SIZES) + 1):
        h = (h * _STEP) ^ (padded[size - 1 : size - 1 + n] + np.uint32(1))
        if size in SIZES:
            ok = some & (left >= size - 1) & ((size > 1) | ~border[:-1])
            out[ok, SIZES.index(size)] = _bucket(h + np.uint32(size))[ok]
    if len(starts):
        place = np.arange(n) - np.repeat(starts, length)
        whole = np.add.reduceat((codes[:-1] * np.uint32(0x85EBCA6B)) ^ _mixed(place), starts, dtype=np.uint32)
        out[starts, -1] = np.where(length > 1, _bucket(whole), BUCKETS)
    return out, starts


def _lower(word: str, at: int, end: int) -> str:
    """A part of a word in lower case, as it is in the whole word: the letter sigma depends on those around it."""
    parts = word[at:end].split("\u03a3")
    out, i = [parts[0].lower()], at + len(parts[0])
    for part in parts[1:]:
        before = word[max(0, i - 64) : i]
        out += [(before + word[i : i + 65]).lower()[len(before.lower())], part.lower()]
        i += 1 + len(part)
    return "".join(out)


def long_row(word: str, table: np.ndarray, piece: int = 1 << 18) -> np.ndarray:
    """The sum of the rows of ``table`` for all units of a long word, piece by piece."""
    total, reach = np.zeros(table.shape[1]), max(SIZES) - 1
    held, whole, place, at, first = np.zeros(1, np.uint32), np.zeros(1, np.uint32), 1, 0, True  # the border before the word
    while True:
        end = min(at + piece, len(word))
        codes = np.frombuffer(_lower(word, at, end).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = codes[_alphabetic()[codes]]
        whole += ((codes * np.uint32(0x85EBCA6B)) ^ _mixed(np.arange(place, place + len(codes)))).sum(dtype=np.uint32)
        at, done, place = end, end >= len(word), place + len(codes)
        held = np.concatenate([held, codes, np.zeros(1, np.uint32)] if done else [held, codes])
        n = len(held) - (1 if done else reach)  # grams that begin here are complete
        if n > 0 and place > 1:
            h = np.zeros(n, np.uint32)
            padded = np.concatenate([held, np.zeros(reach, np.uint32)])
            for size in range(1, reach + 2):
                h = (h * _STEP) ^ (padded[size - 1 : size - 1 + n] + np.uint32(1))
                if size in SIZES:
                    ok = np.arange(n) <= len(held) - size
                    ok[0] &= size > 1 or not first
                    total += table[_bucket(h + np.uint32(size))[ok]].sum(axis=0)
            held, first = held[n:], False
        if done:
            return total + table[_bucket(whole)[0]] if place > 1 else np.zeros(table.shape[1])


def _mixed(place: np.ndarray) -> np.ndarray:
    h = place.astype(np.uint32) * np.uint32(0x9E3779B1)
    return h ^ (h >> np.uint32(13))


def parted(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words of texts, the number of each word of all texts in turn, and where each text's words begin (one more at the end)."""
    lists = pc.utf8_split_whitespace(texts.fill_null(""))
    offsets = lists.offsets.to_numpy()
    coded = pc.dictionary_encode(lists.flatten())
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), offsets - offsets[0]


def sums(rows: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the rows between consecutive offsets."""
    out = np.zeros((len(offsets) - 1, rows.shape[1]))
    full = offsets[1:] > offsets[:-1]
    if full.any():
        out[full] = np.add.reduceat(rows, offsets[:-1][full], axis=0)
    return out


@dataclass
class LanguageModel:
    langs: list[str]
    logits: np.ndarray  # of each bucket, by language
    temperature: float = 1.0
    threshold: float = 0.0

    def probabilities(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated, a row a text; and whether the text has a letter (its row counts only then)."""
        table = np.zeros((BUCKETS + 1, len(self.langs) + 1))
        table[:BUCKETS, :-1], table[:BUCKETS, -1] = self.logits, 1
        if len(texts) == 1 and texts.nbytes > 4 * STRETCH:
            text, total = texts[0].as_py() or "", np.zeros((1, table.shape[1]))
            for at, end in stretches(text):
                total[0] += long_row(text[at:end], table) if end - at > 2 * STRETCH else _rows(pa.array([text[at:end]]), table)[0]
        else:
            total = _rows(texts, table)
        known = (total[:, -1] > 0) & bool(self.langs)
        z = total[:, :-1] / np.maximum(total[:, -1:], 1) / self.temperature
        return (_softmax(z) if self.langs else z), known


def stretches(text: str, size: int = STRETCH) -> Iterator[tuple[int, int]]:
    """Stretches of about ``size`` characters that end at blanks; one of over twice the size is one word."""
    at = 0
    while at < len(text):
        found = _BLANK.search(text, at + size)
        end = found.start() if found else len(text)
        if end - at > 2 * size and (first := _last_blank(text, at, at + size)) > at:
            end = first  # what is before the long word
        yield at, end
        at = end


def _last_blank(text: str, at: int, end: int) -> int:
    """The end of the last blank from ``at`` to ``end``, or ``at``."""
    while end > at:
        begin = max(at, end - 4096)
        last = [m.end() for m in _BLANK.finditer(text, begin, end)]
        if last:
            return last[-1]
        end = begin
    return at


def _rows(texts: pa.Array, table: np.ndarray) -> np.ndarray:
    """The sum of the rows of ``table`` for all units of each text."""
    words, numbers, offsets = parted(texts)
    grams, starts = units(words)
    shares = table[grams[:, 0]]
    for c in range(1, grams.shape[1]):
        shares += table[grams[:, c]]
    of_word = np.add.reduceat(shares, starts, axis=0) if len(starts) else np.zeros((0, table.shape[1]))
    return sums(of_word[numbers], offsets)


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=-1, keepdims=True))
    return p / p.sum(axis=-1, keepdims=True)


def dealt(docs: np.ndarray, langs: np.ndarray, most: int, rng: np.random.Generator) -> np.ndarray:
    """At most ``most`` places of lines in random order: the languages take turns, within each its documents, within each its lines."""

    def turns(keys: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Of each line, how many lines with the same key come before it in ``order``."""
        by = order[np.argsort(keys[order], kind="stable")]
        k = keys[by]
        new = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
        out = np.zeros(len(keys), np.int64)
        out[by] = np.arange(len(k)) - np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
        return out

    order = rng.permutation(len(docs))
    for keys in (docs, langs):
        order = order[np.argsort(turns(keys, order)[order], kind="stable")]
    return rng.permutation(order[:most])


def train(lines: list[str], langs: list[str], docs: list[int], epochs: int = 4, rate: float = 0.4, most_units: int = 8_000, precision: float = 0.995, seed: int = 7) -> LanguageModel:
    """Train on lines, their languages and the numbers of their documents; ``most_units`` lines at most, dealt evenly over the languages and their documents."""
    names = sorted(set(langs))
    rng = np.random.default_rng(seed)
    number = {lang: k for k, lang in enumerate(names)}
    chosen = dealt(np.array(docs, np.int64), np.array([number[lang] for lang in langs], np.int64), most_units, rng)
    if not len(chosen):
        return LanguageModel([], np.zeros((BUCKETS, 0)))
    words, numbers, offsets = parted(pa.array([lines[i] for i in chosen], pa.string()))
    grams, starts = units(words)
    ends = np.append(starts[1:], len(grams))
    of_word = [(g := grams[a:b].ravel())[g < BUCKETS] for a, b in zip(starts, ends, strict=True)]
    bags = [np.unique(np.concatenate([of_word[k] for k in numbers[a:b]]), return_counts=True) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    y, of_doc = np.array([number[langs[i]] for i in chosen]), np.array([docs[i] for i in chosen])
    aside = of_doc % 5 == 0 if len(set(docs)) >= 20 else np.zeros(len(y), bool)
    e = rng.normal(0, 0.1, (BUCKETS, WIDTH))
    w = np.zeros((WIDTH, len(names)))
    weight = len(y) / (len(names) * np.maximum(np.bincount(y, minlength=len(names)), 1)).clip(0.2)
    todo = np.flatnonzero(~aside)
    for epoch in range(epochs):
        for step, i in enumerate(rng.permutation(todo)):
            ids, c = bags[i]
            share = c / c.sum()
            h = share @ e[ids]
            p = _softmax(h @ w)
            p[y[i]] -= 1
            p *= rate * (1 - (epoch * len(todo) + step) / (epochs * len(todo))) * min(5.0, weight[y[i]] ** 0.5)
            back = w @ p
            w -= np.outer(h, p)
            e[ids] -= np.outer(share * len(ids), back) / max(1.0, len(ids) ** 0.5)
    model = LanguageModel(names, e @ w)
    # Calibrated on documents, as they are scored: the units of each that is kept back count together.
    held: dict[int, list[int]] = {}
    for i in np.flatnonzero(aside) if aside.any() else todo:
        held.setdefault(int(of_doc[i]), []).append(int(i))
    z = np.array([sum(bags[i][1] @ model.logits[bags[i][0]] for i in some) / sum(bags[i][1].sum() for i in some) for some in held.values()])
    true = np.array([y[some[0]] for some in held.values()])
    losses = {t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(true)), true], 1e-12)).mean() for t in np.geomspace(0.05, 8, 60)}
    model.temperature = float(min(losses, key=losses.get))
    p = _softmax(z / model.temperature)
    top, right = p.max(axis=1), p.argmax(axis=1) == true
    order = np.argsort(-top, kind="stable")
    good = np.flatnonzero(np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= precision)
    model.threshold = float(top[order][good[-1]]) if len(good) else 1.0
    return model


def pieces(text: str) -> Iterator[tuple[int, str]]:
    """The lines of a text that hold a letter, in pieces of ``PIECE`` characters at most, numbered."""
    i = 0
    for line in text.split("\n"):
        for at in range(0, len(line), PIECE):
            part = line[at : at + PIECE]
            if any(map(str.isalpha, part)):
                yield i, part
            i += 1


def learn(docs: DataFrame, most_docs: int, most_units: int = 8_000) -> LanguageModel:
    """A model from the labelled rows of ``docs`` (doc_id, text, lang) with the least hashes of doc_id."""
    rows = docs.filter("text is not null and lang is not null and doc_id is not null").select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    ids = [r.doc_id for r in rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_docs).collect()]
    each = -(-4 * most_units // max(1, len(ids)))
    least = docs.sparkSession.createDataFrame([(i,) for i in ids], "k long")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for d, text, lang in zip(*(column(batch, c).to_pylist() for c in ("doc_id", "text", "lang")), strict=True):
                some = [x for _, _, x in heapq.nsmallest(each, ((xxhash.xxh3_64_intdigest(f"{i}:{x}".encode("utf-8", "surrogatepass")), i, x) for i, x in pieces(text)))]
                if some:
                    yield record("doc_id:long unit:string lang:string", [d] * len(some), some, [lang] * len(some))

    chosen = rows.join(F.broadcast(least), rows.doc_id == least.k).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    got = sorted(arrow_map(chosen, draw, "doc_id long, unit string, lang string").collect())
    return train([r.unit for r in got], [r.lang for r in got], [r.doc_id for r in got], most_units=most_units)


def identify(docs: DataFrame, most_docs: int = 4_000, folds: int = 3, out: int = 1, most_units: int = 8_000) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row of ``docs`` (doc_id, text, lang).

    Learned only where crc32(doc_id as text) mod ``folds`` is not ``out``; the rest is ``held_out``.
    """
    fold = small_crc(F.col("doc_id")) % folds
    model = docs.sparkSession.sparkContext.broadcast(learn(docs.filter(fold != out), most_docs, most_units))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in slices(batches):
            p, known = m.probabilities(column(batch, "text"))
            score = np.where(known, p.max(axis=1, initial=0.0), 0.0)
            best = p.argmax(axis=1) if m.langs else np.zeros(len(p), int)
            said = [m.langs[k] if ok else "und" for k, ok in zip(best, known, strict=True)]
            yield record("doc_id:long lang_pred:string score:double rejected:boolean", column(batch, "doc_id"), said, pa.array(score), pa.array(score < m.threshold))

    said = arrow_map(texts_of(docs), run, "doc_id long, lang_pred string, score double, rejected boolean")
    return said.select("doc_id", F.coalesce(small_crc(F.col("doc_id")) % folds == out, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
