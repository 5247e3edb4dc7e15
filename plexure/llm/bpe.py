"""Byte-level BPE encoding and decoding, with exact merges in linear time.

Method: token bytes are mapped to Latin-1 so that an Aho-Corasick automaton (pyahocorasick) finds, for
each position of a piece, the longest token that starts there. A backtracking pass takes the longest
token whose neighbour pair is compatible, falls back to the token's next shorter prefix token, and marks
positions from which no end can be reached, so that each is given up once. Two tokens are compatible if
undoing their merges never shows a pair across their border that BPE would have merged first; the answer
is memoised.

Defined results: null is the empty text; the empty text has no ids. Repeated rows are encoded alike.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexure.llm.chunks import ChunkEncoder, split
from plexure.llm.common import arrow_map, column, record, slices, texts_of


# The code points that ``regex`` 2026.9 counts as letters or numbers and tiktoken 0.14, with its older Unicode tables, does not.
_UNASSIGNED = """
558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7
10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6
187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81
1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E
2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""


def matcher(pattern: str) -> Callable[[str], list[str]]:
    """The matches of a pattern in a text, with tiktoken's letters and numbers: what it does not know stands as a private-use character while the text is matched."""
    ends = [x.split("-") for x in _UNASSIGNED.split()]
    unknown = re.compile("[" + "".join(f"{chr(int(x[0], 16))}-{chr(int(x[-1], 16))}" for x in ends) + "]")
    made = regex.compile(pattern)

    def find(text: str) -> list[str]:
        if text.isascii() or not unknown.search(text):
            return made.findall(text)
        return [text[m.start() : m.end()] for m in made.finditer(unknown.sub("\ue000", text))]

    return find


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file of lines "base64 rank"; the file is installed on every machine."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class BytePairCodec:
    """Encodes pieces by the ranks of a byte-level vocabulary that holds all 256 single bytes."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.token_of = {r: b for b, r in ranks.items()}
        self.length = [0] * (max(ranks.values()) + 1)
        for b, r in ranks.items():
            self.length[r] = len(b)
        self.by_text = {b.decode("latin-1"): r for b, r in ranks.items()}
        self.machine = ahocorasick.Automaton()
        for b, r in ranks.items():
            self.machine.add_word(b.decode("latin-1"), (r, len(b)))
        self.machine.make_automaton()
        self.halves, self.joined = {}, {}
        self.shorter: list[int | None] = [None] * len(self.length)
        for b, r in sorted(ranks.items(), key=lambda x: x[1]):
            self.shorter[r] = next((ranks[b[:k]] for k in range(len(b) - 1, 0, -1) if b[:k] in ranks), None)
            parts = self._merge(b, r) if len(b) > 1 else []
            if len(parts) == 2:
                self.halves[r] = (parts[0], parts[1])
                self.joined[parts[0], parts[1]] = r
            else:
                self.halves[r] = (r, r)
        self.memo: dict[int, bool] = {}

    def _merge(self, token: bytes, below: int) -> list[int]:
        """The ids that plain merging by ranks under ``below`` leaves of a token."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE leaves a and b side by side. Merges are undone from the latest; ``cap`` is the rank of the last undone one, which a merge across the border must beat."""
        cap = len(self.ranks) + 1
        while True:
            across = self.joined.get((a, b))
            if across is not None and across < cap:
                return False
            for side in ("left", "right") if a > b else ("right", "left"):
                if side == "left" and self.halves[a][1] != a:
                    cap, a = a, self.halves[a][1]
                    break
                if side == "right" and self.halves[b][0] != b:
                    cap, b = b + 1, self.halves[b][0]
                    break
            else:
                return True

    def encode_piece(self, piece: str) -> list[int]:
        """The ids of one match of the pattern."""
        text = piece.encode("utf-8", "surrogatepass").decode("latin-1")
        whole = self.by_text.get(text)
        if whole is not None:
            return [whole]
        n = len(text)
        longest = [0] * n
        for end, (r, size) in self.machine.iter(text):
            longest[end - size + 1] = r
        length, shorter, memo = self.length, self.shorter, self.memo
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            last = out[-1] << 32 if out else -1
            while token is not None:
                end = at + length[token]
                if not dead[end]:
                    if last < 0:
                        break
                    fits = memo.get(last | token)
                    if fits is None:
                        if len(memo) > 1 << 18:
                            memo.clear()
                        fits = memo[last | token] = self.compatible(out[-1], token)
                    if fits:
                        break
                token = shorter[token]
            if token is None:
                dead[at] = 1
                token = out.pop()
                at -= length[token]
                continue
            out.append(token)
            at = end
            token = longest[at] if at < n else None
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token_of.__getitem__, ids))


@cache
def codec(path: str, pattern: str) -> tuple[BytePairCodec, ChunkEncoder]:
    """One for each Python worker."""
    made = BytePairCodec(read_ranks(path))
    find = matcher(pattern)
    known: dict[str, list[int]] = {}

    def encode_chunks(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids: list[int] = []
        size = []
        if len(known) > 100_000:
            known.clear()
        for c in chunks:
            before = len(ids)
            for p in split(find, c) if c else ():
                got = known.get(p)
                if got is None:
                    got = made.encode_piece(p)
                    if len(p) < 64:
                        known[p] = got
                ids += got
            size.append(len(ids) - before)
        return np.array(ids, "<u4"), np.array(size, np.int64)

    return made, ChunkEncoder(encode_chunks)


def _parts(ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The bytes of each text's ids."""
    data, cut = ids.tobytes(), [0, *(4 * ends).tolist()]
    return [data[a:b] for a, b in zip(cut, cut[1:], strict=False)]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit, as binary) for each row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, encoder = codec(path, pattern)
        for batch in slices(batches, most=4 << 20):
            yield record("doc_id:long ids:binary", column(batch, "doc_id"), _parts(*encoder.encode(column(batch, "text"))))

    return arrow_map(texts_of(docs), run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids and data (the decoded bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, _ = codec(path, pattern)
        for batch in slices(batches, "ids", most=4 << 20):
            ids = column(batch, "ids")
            yield record("doc_id:long ids:binary data:binary", column(batch, "doc_id"), ids, [made.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in ids.to_pylist()])

    return arrow_map(encoded.select("doc_id", "ids"), run, "doc_id long, ids binary, data binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes every text, decodes the ids, and digests both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, encoder = codec(path, pattern)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in slices(batches, most=4 << 20):
            ids = _parts(*encoder.encode(column(batch, "text")))
            back = (made.decode(np.frombuffer(x, "<u4").tolist()) for x in ids)
            yield record("doc_id:long n_tokens:long ids_sha256:string decoded_sha256:string", column(batch, "doc_id"), [len(x) // 4 for x in ids], [sha(x) for x in ids], [sha(x) for x in back])

    return arrow_map(texts_of(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
