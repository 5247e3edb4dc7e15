"""Near-duplicate documents by MinHash.

Method: each document's set of word shingles is sketched by the minima of many multiply-shift universal
hashes; equal bands of minima propose candidates; signatures, then the full sets, confirm them; links
become components by alternating large-star and small-star.

At scale
* Documents with equal sets collapse to one representative first (a map-side combined minimum), so a
  group of exact copies of any size costs one row a task.
* A band's bucket never emits its pairs. Its members are compared with the bucket's least and greatest
  member (rows linear in the bucket). Only buckets that still hold several components go on: their
  members outside the largest component are compared with all members by signatures alone, in blocks of
  bounded size. The full sets of those that agree with a member of another component are then compared in
  the same way, and one link for each pair of components is enough. Every pair that shares a band and may
  join two components is so decided on full sets; none is capped, and members that resemble none are never
  shuffled with their sets.
* Texts are read twice and not shuffled; the full sets exist only for documents that share a band.

Defined results
* null or blank text: an empty set, linked with nothing. Fewer words than a shingle: the whole sequence.
* null doc_id: returned with component_id null and kept true. Rows that share a doc_id are one document.
* extra columns of the input are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexure.llm.common import Scratch, arrow_map, column, opaque, record, slices, texts_of
from plexure.llm.components import connected_components

BANDS, ROWS = 24, 5
HASHES = BANDS * ROWS
BLOCK, LIGHT_BLOCK = 256, 4096
_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)
_BAND_MIX = _rng.integers(1, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORD_MIX = _rng.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _finish(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and odd multiply)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class _Words(dict):
    """Word hashes, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


_words = _Words()


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles (ASCII lower-cased, split at ASCII blanks)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    if n < size:
        return _finish(np.array([np.frombuffer(xxhash.xxh3_64_digest(w.tobytes(), seed=n), np.uint64)[0]], np.uint64))
    x = w[: n - size + 1] * _WORD_MIX[0]
    for i in range(1, size):
        x = x + w[i : n - size + 1 + i] * _WORD_MIX[i % 16]
    return np.unique(_finish(x))


def minima(found: np.ndarray) -> np.ndarray:
    """The least value of each universal hash over the set; multiply-shift on the low 32 bits."""
    out = np.full(HASHES, 0xFFFFFFFF, np.uint64)
    low = found & np.uint64(0xFFFFFFFF)
    for at in range(0, len(low), 1024):
        np.minimum(out, ((_A[:, None] * low[None, at : at + 1024] + _B[:, None]) >> np.uint64(32)).min(axis=1), out=out)
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    """(rows, BANDS) int64 band hashes of (rows, HASHES) minima."""
    return _finish((sig.reshape(-1, BANDS, ROWS) * _BAND_MIX).sum(axis=2)).view(np.int64)


def sketch(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, set_key (128-bit hash of the set), bands, sig (low 16 bits of each minimum)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, keys, sigs = [], [], np.zeros((batch.num_rows, HASHES), np.uint64)
            for i, text in enumerate(column(batch, "text").to_pylist()):
                found = shingles(text, words)
                sizes.append(len(found))
                keys.append(xxhash.xxh3_128_digest(found.tobytes()))
                if len(found):
                    sigs[i] = minima(found)
            b = bands(sigs)
            short = sigs.astype(np.uint16)
            banded = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1) * BANDS, pa.int32()), pa.array(b.ravel()))
            named = "doc_id:long n_shingles:long set_key:binary bands:longs sig:binary"
            yield record(named, column(batch, "doc_id"), sizes, keys, banded, [x.tobytes() for x in short])

    return arrow_map(texts_of(docs), run, "doc_id long, n_shingles long, set_key binary, bands array<bigint>, sig binary")


SEGMENT, PROBES, MOST_BITS = 1 << 19, 3, 1 << 27


def _probes(mixed: np.ndarray, bits: int) -> np.ndarray:
    """(PROBES, n) positions in a filter of ``bits`` for 64-bit hashes."""
    x = mixed.view(np.uint64)
    return np.stack([_finish(x + np.uint64(i)) % np.uint64(bits) for i in range(PROBES)]).astype(np.int64)


def membership_filter(nodes: DataFrame, count: int) -> np.ndarray | None:
    """A Bloom filter of the longs in ``node``, built in segments on the executors; at most MOST_BITS (16 MB), and None where that is under eight bits a node."""
    bits = -(-max(16 * count, SEGMENT) // SEGMENT) * SEGMENT
    if bits > MOST_BITS:
        bits = MOST_BITS
    if bits < 8 * count:
        return None

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _probes(column(batch, "x").to_numpy(), bits).ravel()
            yield record("segment:long at:int", pa.array(at // SEGMENT), pa.array((at % SEGMENT).astype(np.int32)))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            segment, at = column(batch, "segment").to_numpy(), column(batch, "at").to_numpy()
            for k in np.unique(segment):
                found.setdefault(int(k), np.zeros(SEGMENT, bool))[at[segment == k]] = True
        for k, x in found.items():
            yield record("segment:long data:binary", [k], [np.packbits(x).tobytes()])

    dealt = arrow_map(nodes.select(F.xxhash64("node").alias("x")), place, "segment long, at int").repartition("segment")
    out = np.zeros(bits // 8, np.uint8)
    for r in arrow_map(dealt, gather, "segment long, data binary").toLocalIterator():
        out[r.segment * SEGMENT // 8 : (r.segment + 1) * SEGMENT // 8] = np.frombuffer(r.data, np.uint8)
    return out


def shingle_sets(docs: DataFrame, words: int, only: DataFrame) -> DataFrame:
    """node, n, grams: the full sets of the documents whose doc_id is in ``only`` (node), and of a few others perhaps.

    Up to sixteen million nodes a Bloom filter of bounded size picks the documents where they are read; beyond that a join does.
    """
    spark = docs.sparkSession
    made = membership_filter(only, only.count())
    if made is None:
        docs, given, bits = docs.join(only, docs.doc_id == only.node, "left_semi"), None, 0
    else:
        given, bits = spark.sparkContext.broadcast(made), 8 * len(made)
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            if given is not None:
                at = _probes(column(batch, "x").to_numpy(), bits)
                ok = ((given.value[at >> 3] >> (7 - (at & 7))) & 1).all(axis=0)
                batch = batch.filter(pa.array(ok))
                if not batch.num_rows:
                    continue
            sets = [shingles(t, words).view(np.int64) for t in column(batch, "text").to_pylist()]
            at = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
            grams = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(sets)))
            yield record("node:long n:long grams:longs", column(batch, "doc_id"), [len(x) for x in sets], grams)

    return arrow_map(docs, run, "node long, n long, grams array<bigint>")


def _agreement(a: str, b: str):
    """How many minima two signatures share."""

    def count(left, right):
        x = np.frombuffer(b"".join(left), np.uint16).reshape(len(left), -1)
        y = np.frombuffer(b"".join(right), np.uint16).reshape(len(right), -1)
        return (x == y).sum(axis=1)

    @F.pandas_udf("int")
    def agree(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series(count(left, right), dtype="int32") if len(left) else pd.Series([], dtype="int32")

    return agree(F.col(a), F.col(b))


def least_agreement(percent: int) -> int:
    """Minima that a linked pair shares at least: five and a half standard deviations below what is expected."""
    j = percent / 100
    return max(0, int(HASHES * j - 5.5 * (HASHES * j * (1 - j)) ** 0.5))


def _agreeing(percent: int):
    """The members of a block that agree, by size and signature, with one of another component in this bucket first. Batches come sorted by block."""
    least = least_agreement(percent)

    def marked(t: pa.Table) -> pa.RecordBatch | None:
        minor, comp, n = (t[c].to_numpy(zero_copy_only=False) for c in ("minor", "comp", "n"))
        alls, few = np.flatnonzero(~minor), np.flatnonzero(minor)
        if not len(alls) or not len(few):
            return None
        band = t["band"][0].as_py()
        sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint16).reshape(len(n), -1)
        band_of = t["bands"].combine_chunks().flatten().to_numpy().reshape(len(n), -1)
        found = np.zeros(len(n), bool)
        mine, theirs, sizes = sig[alls], band_of[alls], n[alls]
        for r in few.tolist():
            ok = (comp[alls] != comp[r]) & (100 * np.minimum(sizes, n[r]) >= percent * np.maximum(sizes, n[r]))
            some = np.flatnonzero(ok)
            some = some[(mine[some] == sig[r]).sum(axis=1) >= least]
            some = some[(theirs[some] == band_of[r]).argmax(axis=1) == band]
            if len(some):
                found[alls[some]] = found[r] = True
        where = pa.array(np.flatnonzero(found))
        if not found.any():
            return None
        return record("band:int h:long node:long comp:long", *(t[c].take(where).combine_chunks() for c in ("band", "h", "node", "comp")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for batch in batches:
            k = np.stack([column(batch, c).to_numpy().astype(np.int64) for c in ("band", "h", "i", "j")])
            cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1), batch.num_rows]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if s < e and (new := tuple(k[:, s].tolist())) != key:
                    if held and (out := marked(pa.Table.from_batches(held))) is not None:
                        yield out
                    held, key = [], new
                if s < e:
                    held.append(batch.slice(s, e - s))
        if held and (out := marked(pa.Table.from_batches(held))) is not None:
            yield out

    return run


def _block_links(percent: int):
    """Links between the members of a block that lie in different components. Rows come sorted by block."""
    least = least_agreement(percent)

    def links(rows: list[dict]) -> Iterator[tuple[int, int]]:
        band = rows[0]["band"]
        alls, few = [r for r in rows if not r["minor"]], [r for r in rows if r["minor"]]
        if not alls or not few:
            return
        sizes = np.array([r["n"] for r in alls])
        sig = np.frombuffer(b"".join(r["sig"] for r in alls), np.uint16).reshape(len(alls), -1)
        band_of = np.array([r["bands"] for r in alls])
        root = {c: c for r in rows for c in [r["comp"]]}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        for r in few:
            agree = (sig == np.frombuffer(r["sig"], np.uint16)).sum(axis=1)
            same = band_of == np.array(r["bands"])
            ok = (agree >= least) & (100 * np.minimum(sizes, r["n"]) >= percent * np.maximum(sizes, r["n"])) & (same.argmax(axis=1) == band)
            mine = np.asarray(r["grams"])
            for i in np.flatnonzero(ok)[np.argsort(-agree[ok], kind="stable")]:
                other = alls[i]
                if find(other["comp"]) == find(r["comp"]):
                    continue
                at = np.searchsorted(mine, other["grams"])
                common = int((mine[np.minimum(at, len(mine) - 1)] == other["grams"]).sum())
                if 100 * common >= percent * (len(mine) + len(other["grams"]) - common):
                    root[find(other["comp"])] = find(r["comp"])
                    yield r["comp"], other["comp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, out = [], None, []
        for batch in batches:
            grams = column(batch, "grams")
            flat, offs = grams.values.to_numpy(zero_copy_only=False), grams.offsets.to_numpy()
            rest = batch.drop_columns(["grams"]).to_pylist()
            for i, r in enumerate(rest):
                r["grams"] = np.sort(flat[offs[i] : offs[i + 1]].view(np.uint64))
                k = (r["band"], r["h"], r["i"], r["j"])
                if k != key:
                    out += links(held) if held else []
                    held, key = [], k
                    if len(out) > 10_000:
                        yield record("u:long v:long", [u for u, _ in out], [v for _, v in out])
                        out = []
                held.append(r)
        out += links(held) if held else []
        if out:
            yield record("u:long v:long", [u for u, _ in out], [v for _, v in out])

    return run


def _in_blocks(members: DataFrame, size: int, *columns: str) -> DataFrame:
    """Members of open buckets (band, h, node, comp) dealt to blocks: those outside the bucket's largest component (``minor``) meet all, a block of each at a time."""
    shares = members.groupBy("band", "h", "comp").agg(F.count("*").alias("c"))
    buckets = shares.groupBy("band", "h").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("all"), F.count("*").alias("comps")).filter("comps > 1")
    buckets = buckets.select(
        F.col("band").alias("kb"), F.col("h").alias("kh"), F.col("top.comp").alias("major"), F.ceil(F.col("all") / size).cast("int").alias("ni"),
        F.ceil((F.col("all") - F.col("top.c")) / size).cast("int").alias("nj"),
    )
    open_ = members.join(buckets, (F.col("band") == F.col("kb")) & (F.col("h") == F.col("kh")))
    slot = F.abs(F.xxhash64("node") % F.lit(1 << 30))
    one = lambda n: (slot % F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    as_all = open_.select("band", "h", "node", "comp", F.lit(False).alias("minor"), one("ni").alias("i"), each("nj").alias("j"))
    as_minor = open_.filter("comp <> major").select("band", "h", "node", "comp", F.lit(True).alias("minor"), each("ni").alias("i"), one("nj").alias("j"))
    return as_all.unionByName(as_minor)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    words: words in a shingle. percent: documents link when 100 * |A & B| >= percent * |A | B|.
    A pair at 0.85 shares a band but for one in a million; at 0.80 but for six in a hundred thousand.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    base = texts_of(docs)
    drawn = scratch.keep(sketch(base, words), "sketch")

    # One representative for each distinct set.
    sets = scratch.keep(drawn.filter("n_shingles > 0 and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("node")), "sets")
    ident = drawn.filter("n_shingles > 0 and doc_id is not null")
    chosen = ident.join(sets.withColumnRenamed("set_key", "k"), (F.col("doc_id") == F.col("node")) & (F.col("set_key") == F.col("k")))
    nodes = scratch.keep(chosen.select("node", "n_shingles", "bands", "sig").dropDuplicates(["node", "n_shingles", "sig"]), "nodes")

    # Buckets with several members, their least and greatest member, and the pairs with those two.
    spread = nodes.select("node", F.col("n_shingles").alias("n"), F.posexplode("bands").alias("band", "h"))
    ends = spread.groupBy("band", "h").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("members"))
    buckets = scratch.keep(ends.filter("low < high"), "buckets")
    keyed = buckets.select(F.col("band").alias("kb"), F.col("h").alias("kh"), "low", "high", "members")
    sharing = spread.join(keyed, (F.col("band") == F.col("kb")) & (F.col("h") == F.col("kh")))
    members = scratch.keep(sharing.select("band", "h", "node", "n", "low", "high", "members"), "members")
    scratch.drop(buckets)
    with_ends = F.array(*[F.struct("node", F.col(end).alias("pivot")) for end in ("low", "high")])
    pairs = members.select(F.explode(with_ends).alias("p")).select("p.node", "p.pivot").filter("node <> pivot")
    pairs = pairs.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()

    # Signatures first, then full sets of what shares a band.
    light = nodes.select("node", F.col("n_shingles").alias("n"), "sig")
    left = light.select(F.col("node").alias("ka"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    right = light.select(F.col("node").alias("kb"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    close = scratch.keep(
        pairs.join(left, F.col("a") == F.col("ka")).join(right, opaque(F.col("b")) == F.col("kb"))
        .filter(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
        .filter(_agreement("sa", "sb") >= least_agreement(percent)).select("a", "b"),
        "close",
    )
    shared = scratch.keep(members.select("node").distinct(), "shared")
    full = scratch.keep(shingle_sets(base.filter("doc_id is not null"), words, shared), "full-sets")
    ga = full.select(F.col("node").alias("ka"), F.col("grams").alias("xa"))
    gb = full.select(F.col("node").alias("kb"), F.col("grams").alias("xb"))
    both = close.join(ga, F.col("a") == F.col("ka")).join(gb, opaque(F.col("b")) == F.col("kb"))
    common = F.size(F.array_intersect("xa", "xb"))
    links = both.select("a", "b", common.alias("c"), F.size("xa").alias("na"), F.size("xb").alias("nb")).filter(f"100 * c >= {percent} * (na + nb - c)")
    first = scratch.keep(connected_components(scratch, links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "components")
    scratch.drop(close)

    # Buckets of four or more that still hold several components: by signatures first, then by the full sets of what agrees.
    comp = first.select(F.col("node").alias("kn"), "component")
    placed = members.filter("members > 3").select("band", "h", "node").join(comp, F.col("node") == F.col("kn"), "left")
    placed = placed.select("band", "h", "node", F.coalesce("component", "node").alias("comp"))
    detail = nodes.select(F.col("node").alias("kn"), F.col("n_shingles").alias("n"), "bands", "sig")

    def in_blocks(rows: DataFrame, count: int, each: int) -> DataFrame:
        """Blocks together, about ``each`` of ``count`` rows a task, or fewer where the session has more partitions."""
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // each), 1)
        return rows.repartition(parts, "band", "h", "i", "j").sortWithinPartitions("band", "h", "i", "j")

    light = scratch.keep(_in_blocks(placed, LIGHT_BLOCK), "light-blocks")
    signed = light.join(detail, F.col("node") == F.col("kn")).drop("kn")
    near = arrow_map(in_blocks(signed, light.count(), 16 * LIGHT_BLOCK), _agreeing(percent), "band int, h long, node long, comp long")
    near = scratch.keep(near.distinct(), "agreeing")
    blocks = scratch.keep(_in_blocks(near, BLOCK), "blocks")
    sized = full.select(F.col("node").alias("kf"), "n", "grams")
    loaded = blocks.join(detail.drop("n"), F.col("node") == F.col("kn")).join(sized, F.col("node") == F.col("kf"))
    loaded = loaded.select("band", "h", "i", "j", "node", "comp", "minor", "n", "bands", "sig", "grams")
    late = arrow_map(in_blocks(loaded, blocks.count(), 16 * BLOCK), _block_links(percent), "u long, v long")
    merged = connected_components(scratch, late)
    scratch.drop(members)

    higher = merged.select(F.col("node").alias("kc"), F.col("component").alias("above"))
    last = first.join(higher, opaque(F.col("component")) == F.col("kc"), "left").select("node", F.coalesce("above", "component").alias("component"))
    extra = merged.join(first.select(F.col("node").alias("kn")), F.col("node") == F.col("kn"), "left_anti").select("node", "component")
    final = scratch.keep(last.unionByName(extra), "final")
    of_set = sets.join(final.select(F.col("node").alias("kn"), "component"), F.col("node") == F.col("kn"), "left")
    of_set = of_set.select(F.col("set_key").alias("k"), F.coalesce("component", "node").alias("component"))
    match = (F.col("set_key") == F.col("k")) & (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    out = drawn.select("doc_id", "n_shingles", "set_key").join(of_set, match, "left")
    rows = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
