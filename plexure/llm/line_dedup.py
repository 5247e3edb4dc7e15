"""Repeated runs of lines, found by winnowing.

Method: each line is hashed. Over every least window of consecutive lines that holds ``min_words`` words, the
line with the least hash is selected as a fingerprint (the last, among equals). A run of lines with so many
words contains such a window, and its selection depends on its content alone, so any repeated run shares a
fingerprint. All occurrences of a fingerprint are joined with its first one, by (doc_id, position); each
match is extended line by line both ways; and where the matched run holds ``min_words`` words, the later
copy of it is deleted. Every deleted line stays in an earlier place, so no content is lost from the corpus.

A line's first occurrence may stand in surroundings that hold fewer than ``min_words`` matching words, though the whole
window occurred elsewhere. With ``whole``, windows of several lines are therefore fingerprints too, keyed by all their
lines: each least window from a line on and each least window up to a line. Their first occurrence always matches whole,
and they cover each line of any repeated run that holds ``min_words`` words, wherever it occurred earlier.

At scale: a fingerprint's first occurrence is a map-side combined minimum, so a line in a third of all
documents costs one row a task; occurrences meet the first one only, never each other; matches between two
documents become one row that carries the earlier document's line hashes, not its text.

Defined results: lines are parted by "\\n" and compared without blanks at their ends; blank lines hold no words
and never match alone. A passage that begins or ends inside a line whose rest differs is not found there (see README).
Null text has no lines and stays null; the empty text has one empty line. Rows without a doc_id keep all lines. Equal rows with one doc_id are one document; different texts with one doc_id are
ordered by their hash. A document's runs come back to its rows by doc_id and hash, so that any number of texts may share a doc_id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexure.llm.common import Scratch, arrow_map, column, fresh, opaque, record, slices, texts_of

MIN_WORDS = 8


def line_hashes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash and number of words of each line."""
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    return np.array([xxhash.xxh3_64_intdigest(x.strip()) for x in lines], np.uint64).view(np.int64), np.array([len(x.split()) for x in lines], np.int64)


def selected(hashes: np.ndarray, words: np.ndarray, min_words: int) -> list[int]:
    """Positions of the minima of all least windows that hold ``min_words`` words."""
    out, n, end, held = set(), len(hashes), 0, 0
    for start in range(n):
        while end < n and held < min_words:
            held += int(words[end])
            end += 1
        if held < min_words:
            break
        if words[start]:  # a window that starts with a blank line is not the least one
            part = hashes[start:end]
            full = np.flatnonzero(words[start:end])
            out.add(start + int(full[len(full) - 1 - part[full][::-1].argmin()]))
        held -= int(words[start])
    return sorted(out)


def windows(words: np.ndarray, min_words: int) -> list[tuple[int, int]]:
    """(start, end) of the least windows from each line on and up to each line that hold ``min_words`` words, without those of one line."""
    out, n, w = set(), len(words), words.tolist()
    for back in (False, True):
        end, held, v = 0, 0, w[::-1] if back else w
        for start in range(n):
            while end < n and held < min_words:
                held += v[end]
                end += 1
            if held < min_words:
                break
            if v[start] and end - start > 1:
                out.add((n - end, n - start) if back else (start, end))
            held -= v[start]
    return sorted(out)


def _fingerprints(docs: DataFrame, min_words: int, whole: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, digs, data, words, marks, at, wide = [], [], [], [], [], [], []
            for d, dig, text in zip(*(column(batch, c).to_pylist() for c in ("doc_id", "dig", "text")), strict=True):
                h, w = line_hashes(text)
                pos = selected(h, w, min_words)
                if pos:
                    ids.append(d)
                    digs.append(dig)
                    data.append(h.tobytes())
                    words.append(w.astype(np.int32).tobytes())
                    marks.append(h[pos])
                    at.append(pos)
                    wide.append(windows(w, min_words) if whole else [])
            if ids:
                keys = [[xxhash.xxh3_64_intdigest(x[8 * a : 8 * b]) - (1 << 63) for a, b in found] for x, found in zip(data, wide, strict=True)]
                starts, ends = [[a for a, _ in x] for x in wide], [[b for _, b in x] for x in wide]
                named = "doc_id:long dig:long hashes:binary words:binary marks:longs at:ints keys:longs starts:ints ends:ints"
                yield record(named, ids, digs, data, words, marks, at, keys, starts, ends)

    kinds = "doc_id long, dig long, hashes binary, words binary, marks array<bigint>, at array<int>"
    return arrow_map(docs, run, f"{kinds}, keys array<bigint>, starts array<int>, ends array<int>")


def _later_windows(prints: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, dig, runs: the windows that have an earlier occurrence."""
    wide = prints.select("doc_id", "dig", F.explode(F.arrays_zip("keys", "starts", "ends")).alias("m"))
    wide = wide.select("doc_id", "dig", F.col("m.keys").alias("key"), F.col("m.starts").alias("a"), F.col("m.ends").alias("b"))
    place = F.struct("doc_id", "dig", "a")
    first = wide.groupBy("key").agg(F.min(place).alias("f"), F.max(place).alias("l")).filter("f <> l")
    first = first.select(F.col("key").alias("k"), F.col("f.doc_id").alias("doc0"), F.col("f.dig").alias("dig0"), F.col("f.a").alias("a0"))
    first = scratch.keep(first, "first-windows")
    later = wide.join(first, opaque(F.col("key")) == F.col("k")).filter("not (doc_id = doc0 and dig = dig0 and a = a0)")
    return later.groupBy("doc_id", "dig").agg(F.flatten(F.collect_set(F.array(F.col("a").cast("long"), F.col("b").cast("long")))).alias("runs"))


def matched_runs(h: np.ndarray, w: np.ndarray, other: np.ndarray, pairs: list[tuple[int, int]], same: bool, min_words: int) -> list[tuple[int, int]]:
    """Runs (start, end) of lines in a document that repeat those around the paired positions of an earlier one. ``same``: the document itself."""
    out, done = [], set()
    for p, q in sorted(pairs):
        if (p, q) in done or h[p] != other[q] or (same and q >= p):
            continue
        a = b = 0
        while p - a > 0 and q - a > 0 and h[p - a - 1] == other[q - a - 1]:
            a += 1
        while p + b + 1 < len(h) and q + b + 1 < len(other) and h[p + b + 1] == other[q + b + 1]:
            b += 1
        done.update((p + k, q + k) for k in range(-a, b + 1))
        if int(w[p - a : p + b + 1].sum()) >= min_words:
            out.append((p - a, p + b + 1))
    return out


def repeated_runs(docs: DataFrame, scratch: Scratch, min_words: int, whole: bool) -> DataFrame:
    """doc_id, dig, runs (starts and ends of repeated runs) for the documents that have any, from ``docs`` (doc_id, dig, text)."""
    texts = docs.filter("doc_id is not null and text is not null and text <> ''")
    prints = scratch.keep(_fingerprints(texts, min_words, whole), "fingerprints")
    marks = prints.select("doc_id", "dig", F.explode(F.arrays_zip("marks", "at")).alias("m"))
    marks = marks.select("doc_id", "dig", F.col("m.marks").alias("mark"), F.col("m.at").alias("at"))
    place = F.struct("doc_id", "dig", "at")
    first = marks.groupBy("mark").agg(F.min(place).alias("f"), F.max(place).alias("l")).filter("f <> l")
    first = first.select(F.col("mark").alias("k"), F.col("f.doc_id").alias("doc0"), F.col("f.dig").alias("dig0"), F.col("f.at").alias("at0"))
    first = scratch.keep(first, "first")
    later = marks.join(first, opaque(F.col("mark")) == F.col("k")).filter("not (doc_id = doc0 and dig = dig0 and at = at0)")
    pairs = scratch.keep(later.groupBy("doc_id", "dig", "doc0", "dig0").agg(F.collect_set(F.struct("at", "at0")).alias("hits")), "pairs")
    scratch.drop(first)
    lines = scratch.keep(prints.select("doc_id", "dig", "hashes", "words").dropDuplicates(["doc_id", "dig"]), "lines")
    theirs = lines.select(F.col("doc_id").alias("k0"), F.col("dig").alias("g0"), F.col("hashes").alias("other"))
    mine = lines.select(F.col("doc_id").alias("k1"), F.col("dig").alias("g1"), "hashes", "words")
    loaded = pairs.join(theirs, (opaque(F.col("doc0")) == F.col("k0")) & (F.col("dig0") == F.col("g0"))).drop("k0", "g0")
    loaded = loaded.join(mine, (opaque(F.col("doc_id")) == F.col("k1")) & (F.col("dig") == F.col("g1")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "other"):
            ids, digs, runs = [], [], []
            for r in batch.to_pylist():
                h, w, other = (np.frombuffer(r[c], kind) for c, kind in (("hashes", np.int64), ("words", np.int32), ("other", np.int64)))
                same = (r["doc_id"], r["dig"]) == (r["doc0"], r["dig0"])
                found = matched_runs(h, w, other, [(x["at"], x["at0"]) for x in r["hits"]], same, min_words)
                if found:
                    ids.append(r["doc_id"])
                    digs.append(r["dig"])
                    runs.append([x for s in found for x in s])
            if ids:
                yield record("doc_id:long dig:long runs:longs", ids, digs, runs)

    found = arrow_map(loaded.select("doc_id", "dig", "doc0", "dig0", "hits", "hashes", "words", "other"), run, "doc_id long, dig long, runs array<bigint>")
    if whole:
        found = found.unionByName(_later_windows(prints, scratch))
    return scratch.keep(found.groupBy("doc_id", "dig").agg(F.flatten(F.collect_list("runs")).alias("runs")), "runs")


def _without(text: str | None, runs: list[int] | None) -> tuple[str | None, list[int]]:
    """The text without the runs, and the numbers of the lines that went."""
    if text is None or not runs:
        return text, []
    gone = sorted({i for a, b in zip(runs[::2], runs[1::2], strict=True) for i in range(a, b)})
    drop = set(gone)
    return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop), gone


def _with_runs(docs: DataFrame, min_words: int, name: str, whole: bool) -> DataFrame:
    """``docs`` (doc_id, text and others) with the runs of each text as the column ``name``."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    runs = repeated_runs(texts_of(docs).select("doc_id", _dig(F.col("text")).alias("dig"), "text"), scratch, min_words, whole)
    key, dig = (fresh(docs.columns, c) for c in ("_key", "_dig"))
    runs = runs.select(F.col("doc_id").alias(key), F.col("dig").alias(dig), F.col("runs").alias(name))
    # A merge join at every size: texts are dealt once, and nothing is broadcast that grows.
    mine = (docs.doc_id.cast("long") == runs[key]) & (_dig(docs.text.cast("string")) == runs[dig])
    return docs.hint("merge").join(runs, mine, "left").drop(key, dig)


def _dig(text: Column) -> Column:
    """The hash that tells texts of one doc_id apart."""
    return F.xxhash64(text)


def line_report(docs: DataFrame, min_words: int = MIN_WORDS, whole: bool = False) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (numbers of the deleted lines, joined), text_sha256 (of what stays; null for null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = column(batch, "text").to_pylist()
            done = [_without(t, r) for t, r in zip(texts, column(batch, "_runs").to_pylist(), strict=True)]
            yield record(
                "doc_id:long n_lines:long n_removed:long removed:string text_sha256:string", column(batch, "doc_id"), [0 if t is None else t.count("\n") + 1 for t in texts], [len(g) for _, g in done],
                [",".join(map(str, g)) for _, g in done], [None if t is None else hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t, _ in done],
            )

    marked = _with_runs(texts_of(docs), min_words, "_runs", whole)
    return arrow_map(marked, run, "doc_id long, n_lines long, n_removed long, removed string, text_sha256 string")


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS, whole: bool = True) -> DataFrame:
    """``docs`` with repeated runs deleted from ``text``, and n_chars, if there is one, set to its length. Documents of which no word stays, though they had some, are dropped."""
    names, schema, extra = docs.columns, docs.schema, fresh(docs.columns, "_runs")
    marked = _with_runs(docs, min_words, extra, whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, packed = column(batch, "text").to_pylist(), column(batch, extra).to_pylist()
            done = [_without(t, r) for t, r in zip(texts, packed, strict=True)]
            keep = pa.array([not gone or bool((t or "").strip()) for t, gone in done])
            out = batch.select(names)
            out = out.set_column(names.index("text"), "text", pa.array([t for t, _ in done], out.schema.field("text").type))
            if "n_chars" in names:
                i = names.index("n_chars")
                n = pa.array([len(t) if gone else old for (t, gone), old in zip(done, column(batch, "n_chars").to_pylist(), strict=True)], out.schema.field("n_chars").type)
                out = out.set_column(i, "n_chars", n)
            yield out.filter(keep)

    return marked.select(*names, extra).mapInArrow(run, schema)
