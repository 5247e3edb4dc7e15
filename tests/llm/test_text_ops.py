"""Operators on texts, against brute force, round trips and held-out accuracy, with odd rows of every kind."""

from __future__ import annotations

import base64
import bz2
import gzip
import hashlib
import json
import lzma
import random
import subprocess
import sys
import time
import urllib.parse
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plexure.llm import bpe, langid, line_dedup, near_dedup, quality, secrets, token_file
from plexure.llm.near_dedup import near_duplicates

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
DOCS = "doc_id long, text string, lang string, source string, n_chars long, k string, _runs int"
WORDS = "the of and to in a is that for it as was with be by on not he his are this".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 60)) for _ in range(n))


def table(spark, texts, start=0):
    """A documents table with columns whose names clash with those of the operators."""
    return spark.createDataFrame([(start + i if t != "NOID" else None, None if t == "NULL" else t, "en", "src1", len(t), "x", 1) for i, t in enumerate(texts)], DOCS).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(5)
    base = prose(rng, 80)
    texts = ["NULL", "", "   \n\t ", "one", "two words", base, base, base.replace("the", "teh", 1), base + " and more", "x " * 3000 + base, prose(rng, 3000), "NOID", "Ünïcode ÄÖ 中文 😀", "  　", prose(rng, 40), base.upper()]
    return table(spark, [*texts, *[base + f" tail{i}" for i in range(40)]])


def brute_components(rows, words, percent):
    sets = {}
    for d, t in rows:
        if d is None:
            continue
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}, {d: len(s) for d, s in sets.items()}


def test_near_duplicates_match_brute_force(spark, odd):
    got = near_duplicates(odd, 3, 85).collect()
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    comp, sizes = brute_components(rows, 3, 85)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.n_shingles, r.kept) == (comp[r.doc_id], sizes[r.doc_id], comp[r.doc_id] == r.doc_id)
    assert near_duplicates(odd.limit(0), 3, 85).count() == 0


def test_chained_near_duplicates_in_one_bucket(spark):
    """A long chain of edits: neighbours link, ends do not; all must meet in one component."""
    rng = random.Random(3)
    words = prose(rng, 120).split()
    texts = []
    for _ in range(60):
        texts.append(" ".join(words))
        for _ in range(2):
            words[rng.randrange(len(words))] = f"new{rng.random()}"
    rng.shuffle(texts)
    docs = table(spark, texts)
    comp, _ = brute_components([(r.doc_id, r.text) for r in docs.collect()], 3, 85)
    assert {r.doc_id: r.component_id for r in near_duplicates(docs, 3, 85).collect()} == comp


def test_members_of_a_hot_bucket_that_do_not_link_are_not_shuffled_with_their_sets(spark, monkeypatch):
    """A template in all documents fills buckets with texts that do not link; planted pairs among them are still found."""
    rng = random.Random(8)
    template = " ".join(f"word{i}" for i in range(140))
    texts = [f"{template} " + " ".join(f"own{i}x{j}" for j in range(60)) for i in range(1500)]
    pairs = [(i, 1500 + k) for k, i in enumerate(rng.sample(range(1500), 12))]
    texts += [texts[i].replace(f"own{i}x30 ", "changed ") for i, _ in pairs]
    tables = {}
    keep = near_dedup.Scratch.keep
    def kept(self, df, what):
        tables[what] = keep(self, df, what)
        return tables[what]

    monkeypatch.setattr(near_dedup.Scratch, "keep", kept)
    monkeypatch.setattr(near_dedup, "LIGHT_BLOCK", 64)
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    got = {r.doc_id: r.component_id for r in near_duplicates(table(spark, texts), 3, 85).collect()}
    twin = {b: a for a, b in pairs}
    assert got == {i: twin.get(i, i) for i in range(len(texts))}
    open_nodes = tables["light-blocks"].select("node").distinct().count()
    assert open_nodes > 1000 and tables["blocks"].select("node").distinct().count() < 100


def brute_line_dedup(rows, min_words):
    """Fingerprints by the definition: minima of least windows; first occurrences; extension both ways."""
    docs = [(d, line_dedup.xxhash.xxh3_64_intdigest(t.encode()) - (1 << 63), t) for d, t in sorted({x for x in rows if x[0] is not None and x[1]})]
    gone = {}
    hashed = {(d, g): line_dedup.line_hashes(t) for d, g, t in docs}
    marks = []
    for d, g, _ in docs:
        h, w = hashed[d, g]
        for s in range(len(h)):
            e = next((e for e in range(s, len(h)) if w[s : e + 1].sum() >= min_words), None)
            if e is None or not w[s]:
                continue
            best = min((int(h[i]), -i) for i in range(s, e + 1) if w[i])
            marks.append((best[0], (d, g, -best[1])))
    first = {}
    for m, o in marks:
        first[m] = min(first.get(m, o), o)
    for m, (d, g, p) in set(marks):
        d0, g0, q = first[m]
        if (d, g, p) == (d0, g0, q):
            continue
        h, w = hashed[d, g]
        o, _ = hashed[d0, g0]
        a = b = 0
        while p - a > 0 and q - a > 0 and h[p - a - 1] == o[q - a - 1]:
            a += 1
        while p + b + 1 < len(h) and q + b + 1 < len(o) and h[p + b + 1] == o[q + b + 1]:
            b += 1
        if w[p - a : p + b + 1].sum() >= min_words:
            gone.setdefault((d, g), set()).update(range(p - a, p + b + 1))
    return gone


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(8)
    pool = [prose(rng, n) for n in (3, 4, 5, 9, 12, 20, 60)] + ["", "  "]
    texts = ["\n".join(rng.choice(pool) if rng.random() < 0.6 else prose(rng, 6) for _ in range(rng.randint(1, 14))) for _ in range(60)]
    docs = table(spark, ["NULL", "", "NOID", *texts, texts[0]])
    docs = docs.unionByName(docs.filter("doc_id = 5"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    gone = brute_line_dedup(rows, 8)
    for r in line_dedup.line_report(docs, 8).collect():
        text = next(t for d, t in rows if d == r.doc_id) if r.doc_id is not None else "NOID"
        dig = None if not text else line_dedup.xxhash.xxh3_64_intdigest(text.encode()) - (1 << 63)
        want = sorted(gone.get((r.doc_id, dig), ()))
        assert r.removed == ",".join(map(str, want)) and r.n_removed == len(want)
        if text is None:
            assert r.text_sha256 is None and r.n_lines == 0
        else:
            kept = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in set(want))
            assert r.text_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    assert line_dedup.line_report(docs.limit(0)).count() == 0


def test_whole_line_dedup_finds_any_earlier_occurrence(spark):
    """Passages of common short lines that were first seen in other surroundings, against all runs by brute force."""
    rng = random.Random(12)
    pool = [prose(rng, n) for n in (1, 2, 3, 4, 4, 4, 4, 5)] + [""]
    order = ["\n".join(rng.choice(pool) for _ in range(rng.randint(2, 20))) for _ in range(40)]
    passage = "\n".join(rng.choice(pool[:-1]) for _ in range(16))
    docs = table(spark, [*order, f"{prose(rng, 5)}\n{passage}\n{prose(rng, 5)}", f"{prose(rng, 6)}\n{passage}\n{prose(rng, 6)}"])
    seen, want = set(), {}
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        lines = [x.strip() for x in r.text.split("\n")]
        want[r.doc_id] = set()
        for b in range(1, len(lines) + 1):  # a run's places come in the order of its ends
            for a in range(b):
                if lines[a] and lines[b - 1] and sum(len(x.split()) for x in lines[a:b]) >= 8:
                    if (run := tuple(lines[a:b])) in seen:
                        want[r.doc_id] |= set(range(a, b))
                    seen.add(run)
    got = {r.doc_id: {int(x) for x in r.removed.split(",") if x} for r in line_dedup.line_report(docs, 8, whole=True).collect()}
    for r in docs.collect():
        lines = r.text.split("\n")
        assert got[r.doc_id] >= want[r.doc_id] and not any(lines[i].strip() for i in got[r.doc_id] - want[r.doc_id])
    assert got[41] >= set(range(1, 17))
    out = {r.doc_id: r.text for r in line_dedup.without_repeats(docs).collect()}
    assert passage not in out[41]


def test_texts_that_share_a_doc_id_cost_what_others_do(spark):
    """Rows of one doc_id against the same rows with ids of their own: in the order of the texts' hashes, which breaks ties among them."""
    rng = random.Random(21)
    shared = [prose(rng, 12) for _ in range(30)]
    texts = ["\n".join([prose(rng, 9) for _ in range(6)] + rng.sample(shared, 3)) for _ in range(3000)]
    one = spark.createDataFrame([(7, t) for t in texts], "doc_id long, text string").repartition(8)
    order = {r.text: r.i for r in one.selectExpr("text", "row_number() over (order by xxhash64(text)) i").collect()}
    own = spark.createDataFrame([(order[t], t) for t in texts], "doc_id long, text string").repartition(8)
    took, got = [], []
    for docs in (own, one):
        began = time.time()
        got.append(sorted((r.n_removed, r.removed, r.text_sha256) for r in line_dedup.line_report(docs, whole=True).collect()))
        took.append(time.time() - began)
    assert got[0] == got[1] and sum(n for n, *_ in got[0]) == 3 * 3000 - 30
    assert took[1] < 2 * took[0] + 5


def test_long_passages_go_from_all_but_one_document(spark):
    rng = random.Random(2)
    passage = prose(rng, 55)
    texts = [prose(rng, 30) + "\n" + passage + "\n" + prose(rng, 30) for _ in range(30)]
    clean = [prose(rng, 80) for _ in range(10)]
    out = line_dedup.without_repeats(table(spark, [*texts, *clean])).collect()
    assert sum(passage in r.text for r in out) == 1 and len(out) == 40
    assert {r.text for r in out} >= set(clean)
    assert all(r.n_chars == len(r.text) for r in out if r.doc_id < 30 and passage not in r.text)


def test_bpe_equals_the_library(spark, odd):
    import tiktoken

    codec, _ = bpe.codec(RANKS, PATTERN)
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    for r in bpe.digests(odd, RANKS, PATTERN).collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    back = bpe.decode(bpe.encode(odd, RANKS, PATTERN), RANKS, PATTERN)
    assert all(bytes(r.data).decode() == texts[r.doc_id] for r in back.collect())


def test_bpe_parts_code_points_of_every_age_as_the_library():
    """All letters, numbers, blanks and marks of any age, private and unassigned ones, between others (every 37th of the wide blocks)."""
    import tiktoken

    codec, encoder = bpe.codec(RANKS, PATTERN)
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    ends = [int(y, 16) + d for x in bpe._UNASSIGNED.split() for y in x.split("-") for d in (-1, 0, 1)]
    points = sorted({*range(0x3400), *range(0xA000, 0xAC00), *range(0xE000, 0x20000), *range(0x3400, 0x110000, 37), *ends} - set(range(0xD800, 0xE000)))
    texts = [f"{c}'m x{c}1{c} {c}{c}\n {c}" for c in map(chr, points)]
    for at in range(0, len(texts), 5000):
        ids, last = encoder.encode(pa.array(texts[at : at + 5000]))
        assert [x.tolist() for x in np.split(ids, last)[:-1]] == library.encode_ordinary_batch(texts[at : at + 5000])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["\0", "word,", "$$$ ", "×, ", " ", "  ", "\n", "\t", "a", "The", "'s", "é", "中", "😀", "　", "\xa0", "7", "...", "ing", "zzz", "-"]), max_size=40))
def test_both_tokenizers_agree_with_their_libraries_on_any_text(parts):
    import pyarrow as pa
    import tiktoken
    from tokenizers import Tokenizer

    text = "".join(parts)
    codec, encoder = bpe.codec(RANKS, PATTERN)
    want = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=codec.ranks, special_tokens={}).encode_ordinary(text)
    ids, ends = encoder.encode(pa.array([text, None, "a b"]))
    assert ids[: ends[0]].tolist() == want and ends[1] == ends[0]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids, ends = token_file._tokenizer(public_tokenizers.path("byte_bpe_50k.json")).encode(pa.array([text, "x"]))
    assert ids[: ends[0]].tolist() == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", "<|endoftext|>", "<|endof", "text|>", "word", ".", " ", "  ", "\n", "é", "'s", "\0"]), max_size=12), min_size=1, max_size=5))
def test_literal_added_tokens_are_one_id_as_in_the_library(rows):
    import pyarrow as pa
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["".join(x) for x in rows] + ["page <|endoftext|> next", "word<|endoftext|>.", "plain", "<|endoftext|>"]
    ids, ends = token_file._tokenizer(public_tokenizers.path("byte_bpe_50k.json")).encode(pa.array([*texts, None]))
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert 50256 in want[-1] and [x.tolist() for x in np.split(ids, ends)[:-1]] == [*want, []]


@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_packed_values_come_back(values):
    assert token_file.unpack(*token_file.pack(np.array(values, "<u4")), len(values)).tolist() == values


def test_token_files_round_trip(spark, odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [r for r in odd.collect() if r.doc_id is not None]
    got = {r.doc_id: r for r in token_file.round_trip(odd.filter("doc_id is not null"), public_tokenizers.path("byte_bpe_50k.json")).collect()}
    start = 0
    for r in sorted(rows, key=lambda r: r.doc_id):
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_file.round_trip(odd, public_tokenizers.path("byte_bpe_50k.json")).count() == odd.count()
    assert token_file.round_trip(odd.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_token_files_of_one_doc_id_fill_many_shards(spark, monkeypatch):
    """All rows with one id, a third of them alike, and rows without one: shards stay bounded, places are right."""
    rng = random.Random(25)
    rows = [(7, prose(rng, 30)) for _ in range(600)] + [(7, "the same text again and again")] * 300 + [(None, prose(rng, 5)) for _ in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    monkeypatch.setattr(token_file, "SHARD_BYTES", 4000)
    path, scratch = public_tokenizers.path("byte_bpe_50k.json"), token_file.Scratch(spark, "test-shards")
    token_file.write_tokens(docs, f"{scratch.base}/files", scratch, path, 2)
    shards = spark.read.parquet(f"{scratch.base}/files/blocks").groupBy("shard").agg({"docs": "sum"}).collect()
    assert len(shards) > 8 and max(r["sum(docs)"] for r in shards) < 300
    got = sorted(token_file.round_trip(docs, path).collect(), key=lambda r: r.start)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got[:-1])]).tolist()
    assert [r.doc_id for r in got] == [None] * 50 + [7] * 900 and len({r.ids_crc32 for r in got}) <= 652


def test_secrets_in_plain_sight_and_hidden(spark):
    key = "password = hunter2hunter2"
    b64 = lambda x: base64.b64encode(x if isinstance(x, bytes) else x.encode()).decode()
    hidden = [b64(key), b64(gzip.compress(key.encode())), urllib.parse.quote(key), urllib.parse.quote(b64(b64(zlib.compress(b64(key).encode())))), "".join(f"\\u{ord(c):04x}" for c in key), b64(urllib.parse.quote(key))]
    for x in hidden:
        text = f"some words {x} and more"
        base, every, done = secrets.find_secrets(text)
        assert not base and done and len(every) == 1
        start, kind, end = every[0]
        assert kind == 0 and 11 <= start and end <= 11 + len(x) and end - start >= len(key)
    plain = f'é API_KEY: "abc/+=123" AKIA{"B" * 12} AKIA{"B" * 11} {"0f" * 16} {"0f" * 15} token=short'
    base, every, _ = secrets.find_secrets(plain)
    assert secrets.show(base) == "assign:2:21,access:23:39,hex:56:88" == secrets.show(every)
    # The base pattern consumes a match that is too short before it goes on.
    assert secrets.show(secrets.find_secrets("token=secret:abcdefgh1")[0]) == ""
    assert secrets.find_secrets("ſecret=abcdefghij")[0] == []
    assert secrets.find_secrets("%25" * 40 + "41")[2]
    rows = secrets.scan_documents(table(spark, ["NULL", "", plain, "NOID"])).collect()
    assert {(r.n_assign, r.n_access, r.n_hex) for r in rows} == {(0, 0, 0), (1, 1, 1)}
    assert secrets.scan_documents(table(spark, ["a"]).limit(0)).count() == 0


def test_compressed_layers_are_opened_to_the_last():
    key = b"password = hunter2hunter2"
    b64 = lambda x: base64.b64encode(x).decode()
    rng = random.Random(3)
    packed = [gzip.compress(bytes(rng.choices(range(32, 127), k=60)) + key + b" %d" % i, mtime=0) for i in range(8)]
    hidden = [b64(gzip.compress(gzip.compress(key))), b64(zlib.compress(gzip.compress(b64(zlib.compress(key)).encode()))), b64(gzip.compress(b"\0\1" + key + b"\xff")), b64(b"\0\xff" + key), b64(gzip.compress(b"nothing") + gzip.compress(key))]
    hidden += ["".join(f"\\x{c:02x}" for c in f(key)) for f in (gzip.compress, zlib.compress)] + [repr(x)[2:-1] for x in packed] + [repr(zlib.compress(key))[2:-1]]
    hidden += [f(x) for x in packed for f in (urllib.parse.quote, urllib.parse.quote_plus)] + [urllib.parse.quote(zlib.compress(key)), "%00%FF" + "".join(f"%{c:02X}" for c in key)]
    for x in hidden:
        _, every, done = secrets.find_secrets(f"some words {x} and more")
        assert done and [k for _, k, _ in every] == [0] * len(every) and every, x
        assert all(11 <= a < b <= 11 + len(x) for a, _, b in every)


def test_base64_is_found_where_it_touches_others_or_is_wrapped():
    b64 = lambda x: base64.b64encode(x).decode()
    code, packed = b64(b"password=hunter2hunter2"), gzip.compress(bytes(random.Random(1).choices(range(32, 127), k=150)) + b"\npassword=hunter2hunter2", mtime=0)
    lines = base64.encodebytes(packed).decode()
    hidden = [f"{x}{c}{y}" for x in ("https://h.example/cb/", "session-", "/v1/", "key_", "a", "ab", "abc", "") for y in ("", "/more", "-x", "z") for c in (code.rstrip("="), b64(packed).rstrip("="))]
    hidden += [lines, lines.replace("\n", "\r\n  "), lines.replace("\n", "\\n"), "-----BEGIN X-----\n" + lines + "-----END X-----"]
    for x in hidden:
        _, every, done = secrets.find_secrets(f"some words {x} and more")
        assert done and every and all(k == 0 and 11 <= a < b <= 11 + len(x) for a, k, b in every), x
    # Exactly the groups of four that hold it.
    assert secrets.find_secrets(f"key_{code}")[1] == [(4, 0, 4 + len(code))] and secrets.find_secrets(f"a{code}")[1] == [(1, 0, 1 + len(code))]


_BOMB = """
import base64, resource, sys, zlib
from plexure.llm.secrets import find_secrets
c = zlib.compressobj(9, zlib.DEFLATED, 31)
data = b"".join([*(c.compress(b"lorem ips " * 100_000) for _ in range(265)), c.compress(b" x^2 password=hunter2hunter2 "), c.flush()])
text = "see " + base64.b64encode(data).decode() + " end"
del data
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
base, found, complete = find_secrets(text)
print(base, (4, 0, len(text) - 4) in found, complete, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""


def test_a_stream_that_inflates_to_the_limit_takes_under_a_gigabyte():
    out = subprocess.run([sys.executable, "-c", _BOMB], capture_output=True, text=True, check=True, timeout=120, cwd=Path(__file__).parents[2]).stdout.split()
    assert out[:3] == ["[]", "True", "True"] and int(out[3]) < 1_000_000  # kilobytes


def test_long_runs_take_linear_time():
    chains = ("%" + "25" * 150_000 + "41", "\\x5c" + "x5c" * 100_000 + "x41", "%5Cx25" + "5Cx25" * 60_000 + "41", "%" + "25" * 20 + "41" + "a" * 800_000)
    for text in chains:
        began = time.time()
        _, every, done = secrets.find_secrets(text)
        assert time.time() - began < 10 and done and len(every) < 20
    for text in ("A1b2" * 200_000, "a" * 800_000, "ab12\n" * 160_000, "Ab12Cd34\nx\n" * 70_000, "\\u0041" * 100_000, "%41" * 200_000, "token " + " " * 800_000, ("Ab3/" * 19 + "\n") * 8_000):
        began = time.time()
        secrets.find_secrets(text)
        assert time.time() - began < 10


def _raw(x: bytes) -> bytes:
    c = zlib.compressobj(9, zlib.DEFLATED, -15)
    return c.compress(x) + c.flush()


def _b64(x: bytes) -> str:
    return base64.b64encode(x).decode()


#: Ways to hide a text, each of which a decoder of the worklist undoes.
HIDE = {
    "percent": lambda t: "".join(f"%{c:02X}" for c in t.encode()), "quote": lambda t: urllib.parse.quote(t, safe=""), "u4": lambda t: "".join(f"\\u{ord(c):04x}" for c in t),
    "x2": lambda t: "".join(f"\\x{ord(c):02x}" for c in t), "u8": lambda t: "".join(f"\\U{ord(c):08x}" for c in t), "braces": lambda t: "".join(f"\\u{{{ord(c):x}}}" for c in t),
    "percent u": lambda t: "".join(f"%u{ord(c):04X}" for c in t), "octal": lambda t: "".join(f"\\{ord(c):03o}" for c in t), "base64": lambda t: _b64(t.encode()),
    "16 bits": lambda t: _b64(t.encode("utf-16-le")), "16 bits, other order": lambda t: _b64(t.encode("utf-16-be")), "gzip": lambda t: _b64(gzip.compress(t.encode())),
    "zlib": lambda t: _b64(zlib.compress(t.encode())), "bare": lambda t: _b64(_raw(t.encode())), "bzip2": lambda t: _b64(bz2.compress(t.encode())), "xz": lambda t: _b64(lzma.compress(t.encode())),
    "lines": lambda t: "\n".join(x[i : i + 8] for x in [_b64(t.encode())] for i in range(0, len(x), 8)),
}


@pytest.mark.parametrize("way", HIDE)
def test_each_way_of_hiding_is_undone(way):
    key = "password = hunter2hunter2"
    x = HIDE[way](key)
    base, every, done = secrets.find_secrets(f"some words {x} and more")
    assert not base and done and every == [(11, 0, 11 + len(x))]


def test_nested_ways_of_hiding_are_undone():
    """Random nestings, deeper than the layers that come off one by one, over a secret that only the innermost shows."""
    rng = random.Random(17)
    escapes = ["percent", "quote", "u4", "x2", "braces", "percent u", "octal"]
    for _ in range(60):
        x, ways = "password = hunter2hunter2", [rng.choice(list(HIDE)) for _ in range(rng.randint(1, 3))]
        for way in ways:
            x = HIDE[way](x)
        assert len(x) < 200_000
        _, every, done = secrets.find_secrets(f"some words {x} and more")
        assert done and any(k == 0 and 11 <= a < b <= 11 + len(x) for a, k, b in every), ways
    for way in escapes:
        for other in escapes:
            x = "password=hunter2hunter2 "
            for i in range(9):  # one character after the other, so that the text stays short
                x = x[:i] + HIDE[(way, other)[i % 2]](x[i]) + x[i + 1 :]
            for _ in range(12):
                x = x.replace("%", "%25")
            assert any(k == 0 for _, k, _ in secrets.find_secrets(x)[1]), (way, other)


def test_what_comes_off_at_once_keeps_its_places():
    """The last step against undoing one escape at a time."""
    rng = random.Random(19)
    for _ in range(300):
        text = "".join(rng.choice(["%", "\\", "25", "5c", "41", "x", "u00", "x5c", "%25", "{", "}", "7", "é", "\\u{70}", "%C3%A9", "\\ud83d\\ude00", " "]) for _ in range(rng.randint(1, 14)))
        made = list(secrets._flat((text, None, None, 0)))
        new, low, high = (made[0][0], made[0][1], made[0][2]) if made else (text, np.arange(len(text)), np.arange(1, len(text) + 1))
        assert not secrets._PERCENT.search(new) and not secrets._ESCAPE.search(new), text
        assert low[0] == 0 and high[-1] == len(text) and (low[1:] == high[:-1]).all()
        assert all(c == text[a] for c, a, b in zip(new, low, high, strict=True) if b - a == 1)


def test_bytes_between_literals_and_escapes_keep_their_places():
    """Maps of mixed escapes against decoding character by character."""
    rng = random.Random(13)
    for _ in range(40):
        plain = "".join(rng.choice(["a", "é", "😀", "password=abcdefgh1 ", " ", "x"]) for _ in range(rng.randint(1, 12)))
        parts = [(c, rng.choice(["plain", "percent", "unicode"])) for c in plain]
        shown = [c if kind == "plain" else urllib.parse.quote(c, safe="").replace(c, "%" + c.encode().hex()) if kind == "percent" else "".join(f"\\u{u:04x}" for u in np.frombuffer(c.encode("utf-16-le"), np.uint16)) for c, kind in parts]
        text = "".join(shown)
        starts = np.cumsum([0, *map(len, shown)])
        want = {(int(starts[a]), k, int(starts[b])) for a, k, b in secrets.scan(plain)}
        assert want <= set(secrets.find_secrets(text)[1])


def test_only_newly_decoded_characters_count_and_other_layers_go_on():
    key = "password%20%3D%20hunter2hunter2"
    for _ in range(3):
        key = key.replace("%", "%25")
    filler = "word " * 400
    _, every, done = secrets.find_secrets(filler + key, most=1000)
    assert done and every == [(2000, 0, 2000 + len(key))]
    bomb = base64.b64encode(zlib.compress(b"a " * 5000)).decode()
    code = base64.b64encode(b"password = hunter2hunter2").decode()
    for text in (f"{bomb} {code}", f"{code} {bomb}"):
        _, every, done = secrets.find_secrets(text, most=1000)
        assert not done and every == [(text.index(code), 0, text.index(code) + len(code))]


def test_quality_learns_on_some_and_holds_on_others(spark):
    rng = random.Random(4)
    texts = [prose(rng, rng.randint(5, 90)) if i % 4 else " ".join(w + "$$$" for w in prose(rng, rng.randint(5, 90)).split()) for i in range(240)]
    docs = table(spark, [*texts, "NULL", "", "NOID"])
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(200)] + [(200, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.score_documents(docs, labels).collect()
    assert len(got) == 243 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.predicted == int(r.doc_id % 4 > 0) for r in got if r.doc_id is not None and r.doc_id < 240)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {i for i in range(240) if i % 4}
    none = quality.score_documents(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.score_documents(docs.limit(0), labels).count() == 0


def test_additive_model_scores_by_its_tables():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    m = quality.fit(x, y, rounds=20)
    assert ((m.score(x) > 0.5) == y).mean() > 0.9 and m.pairs  # an interaction that single features cannot show
    row = m.start + sum(t[np.searchsorted(e, v, "right")] for e, t, v in zip(m.edges, m.tables, x[3], strict=True)) + sum(t[np.searchsorted(m.pair_edges[i], x[3, i], "right"), np.searchsorted(m.pair_edges[j], x[3, j], "right")] for i, j, t in m.pairs)
    assert np.isclose(m.raw(x)[3], row)


def test_long_documents_leave_lines_to_others(monkeypatch):
    """Two documents supply most lines; those of a language with five short documents are still learned from."""
    learned, units = set(), langid.units
    monkeypatch.setattr(langid, "units", lambda words: learned.update(words) or units(words))
    lines = [("lala mola", "aa", 0)] * 3000 + [("krtz strz", "bb", 1)] * 3000 + [(f"bufi{c}", "cc", 2 + i) for i, c in enumerate("abcde")]
    langid.train(*map(list, zip(*lines, strict=True)), most_units=60)
    assert learned == {"lala", "mola", "krtz", "strz", *[f"bufi{c}" for c in "abcde"]}
    taken = langid.dealt(np.repeat([0, 1, 2, 3], [1000, 1000, 5, 1]), np.repeat([0, 0, 1, 1], [1000, 1000, 5, 1]), 20, np.random.default_rng(0))
    assert np.bincount(np.searchsorted([1000, 2000, 2005], taken, "right"), minlength=4).tolist() == [7, 7, 5, 1]


def test_languages_are_told_apart(spark):
    rng = random.Random(6)
    kinds = {"aa": ["lala", "mola", "alma"], "bb": ["krtz", "strz", "zkrt"]}
    rows = [(i, " ".join(rng.choice(kinds[k]) for _ in range(12)), k, "s", 1, "x", 1) for i in range(120) for k in [rng.choice(["aa", "bb"])]]
    docs = spark.createDataFrame([*rows, (500, None, "aa", "s", 1, "x", 1), (501, "12 34 --", "aa", "s", 1, "x", 1), (502, "alma", None, "s", 1, "x", 1), (None, "mola", "aa", "s", 1, "x", 1)], DOCS)
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert all(got[i].lang_pred == k for i, _, k, *_ in rows)
    assert got[500].lang_pred == got[501].lang_pred == "und" and got[500].score == 0 and got[502].lang_pred == "aa"
    assert all(r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", docs.lang.substr(9, 1)).filter("doc_id < 0")).collect()} == set()
    assert json.dumps(langid.train([], [], []).langs) == "[]"


def test_units_are_the_grams_of_each_word():
    """Alone or among others, a word has the same units: its letters' grams with borders, one of each place and length, and itself."""
    words = ["a", "", "Don't", "12--", "İstanbul", "ÉTÉ", "中文", "x" * 50, "don", "ΟΔΟΣ", "a"]
    grams, starts = langid.units(words)
    ends = np.append(starts[1:], len(grams))
    for w, a, b in zip(words, starts, ends, strict=True):
        letters = [c for c in w.lower() if c.isalpha()]
        mine, alone = grams[a:b][grams[a:b] < langid.BUCKETS], langid.units([w])[0]
        assert mine.tolist() == alone[alone < langid.BUCKETS].tolist()
        bordered = ["<", *letters, ">"]
        count = sum(1 for n in langid.SIZES for i in range(len(bordered) - n + 1) if n > 1 or bordered[i] not in "<>") + 1
        assert len(mine) == (count if letters else 0)
    assert np.array_equal(langid.units(["Don't"])[0], langid.units(["dont"])[0])
    assert langid.units([])[0].max(initial=langid.BUCKETS) == langid.BUCKETS


def test_scores_of_texts_sum_their_words():
    rng = np.random.default_rng(3)
    m = langid.LanguageModel(["aa", "bb"], rng.normal(size=(langid.BUCKETS, 2)), 0.7)
    texts = ["one two  two\nthree", None, "", " 12 ", "two", "  one  "]
    p, known = m.probabilities(pa.array(["skipped", *texts], pa.string()).slice(1))
    assert known.tolist() == [True, False, False, False, True, True]
    for i in (0, 4, 5):
        bag = np.concatenate([(g := langid.units([w])[0].ravel())[g < langid.BUCKETS] for w in texts[i].split()])
        z = np.exp(m.logits[bag].mean(axis=0) / 0.7)
        assert np.allclose(p[i], z / z.sum())


def test_long_words_in_pieces_score_as_the_whole():
    rng = np.random.default_rng(23)
    table = np.vstack([rng.normal(size=(langid.BUCKETS, 3)), np.zeros((1, 3))])
    pick = random.Random(24)
    for letters in ("abc", "\u03a3\u03c3\u03b1\u0391ab", "\u0130iI\u00df", "a1-_", "\u4f60\u597d\u306e", "7-", "\u03a3'a"):
        for _ in range(12):
            word = "".join(pick.choice(letters) for _ in range(pick.randint(1, 400)))
            want = langid._rows(pa.array([word]), table)[0]
            for piece in (7, 64, 1000):
                assert np.allclose(langid.long_row(word, table, piece), want, atol=1e-9), (word, piece)
    text = "".join(pick.choice(["word ", "a" * 90, "  ", "\u3000", "\n", "b\x1cc", "x" * 30 + " "]) for _ in range(400))
    parts = [text[a:b] for a, b in langid.stretches(text, 50)]
    assert "".join(parts) == text
    total = sum(langid._rows(pa.array([p]), table)[0] for p in parts)
    assert np.allclose(total, langid._rows(pa.array([text]), table)[0], atol=1e-9)
    assert all(len(p.split()) == 1 for p in parts if len(p) > 100)


_LONG_WORD = """
import resource
import numpy as np
import pyarrow as pa
from plexure.llm import langid
model = langid.LanguageModel(["a", "b"], np.random.default_rng(1).normal(size=(langid.BUCKETS, 2)))
model.probabilities(pa.array(["warm up"]))
text = pa.array(["Ab3dE" * 13_000_000])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
p, known = model.probabilities(text)
print(known[0], resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""


def test_a_word_of_65_million_letters_takes_under_300_megabytes_more():
    out = subprocess.run([sys.executable, "-c", _LONG_WORD], capture_output=True, text=True, check=True, timeout=300, cwd=Path(__file__).parents[2]).stdout.split()
    assert out[0] == "True" and int(out[1]) < 300_000  # kilobytes


def test_units_of_training_are_drawn_from_whole_documents(spark):
    """A long line is cut into pieces, all of which may be drawn; what reaches the driver is bounded."""
    long = " ".join(f"wort{i}" for i in range(2000))
    assert "".join(x for _, x in langid.pieces(long)) == long and max(len(x) for _, x in langid.pieces(long)) <= langid.PIECE
    docs = spark.createDataFrame([(1, long, "de"), (2, "the\n" * 500, "en"), (2, "of", "en")], "doc_id long, text string, lang string")
    assert set(langid.learn(docs, 10, 40).langs) == {"de", "en"}
