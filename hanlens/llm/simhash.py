"""SimHash near-dedup with Golay-code fuzzy keys (operator 6).

A fingerprint holds for each bit the strict majority over the XXH64 (seed 42) of
all 3-word shingles.  Two fingerprints link when they differ in at most 3 bits.

*Keys.*  The 64 bits are three segments of 22, 21 and 21 bits, each taken as a
word of the perfect binary Golay code (23, 12, 7), which decodes any word to the
one codeword within distance 3.  Of at most 3 errors in three segments, two
segments have at most one each (pigeonhole).  For such a segment the codeword of
one side is among those that the other side reaches by no or one flipped bit: one
key for 14 % of the words, at most six for the others.  So a fingerprint is filed under the
codeword indices of each pair of segments, and looked up under the products of
the reachable ones; both meet by key and are compared exactly.

*Size.*  Equal fingerprints are one node from the start.  Keys travel packed, in
buckets whose number follows the number of nodes, and a bucket returns only the
links of a spanning forest of what it verified; dense groups are linked along
sorted orders first, then only across what is still apart, so thousands of near
copies cost no square of rows.  Components come from ``graph.components``.

Cases: a null or blank text has fingerprint zero and links like any other; texts
of one or two words have one shingle, the whole sequence; a very long text is
hashed whole, its bits counted 65,536 shingles at a time; a bit set in exactly
half the shingles (a tie) is 0; repeated rows share their fingerprint; a
component of null ids alone has a null id; an empty table gives an empty result;
other columns stay in ``near_dedup``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batch, shuffle_partitions, texts, written
from .exact_dedup import numbered
from .graph import components, skew_lookup

SEGMENTS = ((0, 22), (22, 21), (43, 21))
MOST_BITS = 3
#: Keys of a bucket, about.
BUCKET_KEYS = 1_000_000
#: A key's group above this size is linked class by class and not pair by pair.
DENSE = 1500
_GENERATOR = 0b101011100011
_hash = partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(text: bytes) -> int:
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < 3:
        return _hash(b" ".join(words))
    n = len(words) - 2
    h = np.fromiter(map(_hash, map(b" ".join, zip(words, words[1:], words[2:], strict=False))), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        ones += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _golay() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of all 12-bit heads (to fold a word), and the error pattern of each syndrome."""

    def remainder(word: int) -> int:
        for k in range(22, 10, -1):
            if word >> k & 1:
                word ^= _GENERATOR << (k - 11)
        return word

    heads = np.array([remainder(head << 11) for head in range(1 << 12)], np.uint32)
    errors = np.zeros(1 << 11, np.uint32)
    bits = [1 << k for k in range(23)]
    for e in {0, *(a | b | c for a, b, c in product(bits, repeat=3))}:
        errors[heads[e >> 11] ^ (e & 0x7FF)] = e
    return heads, errors


_HEADS, _ERRORS = _golay()


def codeword_index(words: np.ndarray) -> np.ndarray:
    """Index (its 12 message bits) of the codeword nearest to each 23-bit word."""
    return (words ^ _ERRORS[_HEADS[words >> 11] ^ (words & 0x7FF)]) >> 11


def segment_keys(fps: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each segment: the index of every fingerprint, and (n, 1 + bits) reachable ones, sorted, repeats as -1."""
    own, reach = [], []
    for low, bits in SEGMENTS:
        word = ((fps >> np.uint64(low)) & np.uint64((1 << bits) - 1)).astype(np.uint32)
        flips = np.array([0, *(1 << k for k in range(bits))], np.uint32)
        own.append(codeword_index(word).astype(np.int64))
        near = np.sort(codeword_index(word[:, None] ^ flips).astype(np.int64), axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        reach.append(-np.sort(-near, axis=1)[:, :6])
    return own, reach


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, fingerprints) to file and (keys, fingerprints) to look up."""
    own, reach = segment_keys(fps)
    filed, looked, of = [], [], []
    for pair, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        filed.append((pair << 24) | (own[i] << 12) | own[j])
        for a, b in product(range(6), repeat=2):
            there = (reach[i][:, a] >= 0) & (reach[j][:, b] >= 0)
            looked.append(((pair << 24) | (reach[i][:, a] << 12) | reach[j][:, b])[there])
            of.append(fps[there])
    return np.concatenate(filed), np.tile(fps, 3), np.concatenate(looked), np.concatenate(of)


class Forest:
    """Union-find over 0..n-1 that keeps the links it used."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def classes(self) -> np.ndarray:
        while not np.array_equal(top := self.up[self.up], self.up):
            self.up = top
        return self.up

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        """Unite many pairs; those already together are sieved out every few thousand."""
        step = 2048
        while len(a):
            for x, y in zip(a[:step].tolist(), b[:step].tolist(), strict=True):
                if (p := self.root(x)) != (q := self.root(y)):
                    self.up[max(p, q)] = min(p, q)
                    self.links.append((x, y))
            of = self.classes()
            a, b = a[step:], b[step:]
            apart = of[a] != of[b]
            a, b = a[apart], b[apart]


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= MOST_BITS


def link_dense(forest: Forest, fps: np.ndarray, members: np.ndarray) -> None:
    """Unite all members within ``MOST_BITS``: along sorted orders first, then what is outside the largest class against all."""
    own, local = fps[members], Forest(len(members))
    _, first, back = np.unique(forest.classes()[members], return_index=True, return_inverse=True)
    local.up = first[back]
    for turn in range(0, 64, 8):
        turned = (own << np.uint64(turn)) | (own >> np.uint64(64 - turn)) if turn else own
        order = np.argsort(turned)
        for gap in (1, 2, 3):
            a, b = order[:-gap], order[gap:]
            close = _near(own[a], own[b])
            local.unite(a[close], b[close])
    of = local.classes()
    roots, sizes = np.unique(of, return_counts=True)
    apart = np.flatnonzero(of != roots[np.argmax(sizes)])
    step = max(1, (1 << 22) // len(members))
    for k in range(0, len(apart), step):
        x, y = np.nonzero(_near(own[apart[k : k + step]][:, None], own[None, :]))
        local.unite(apart[k + x], y)
    links = np.array(local.links, np.int64).reshape(-1, 2)
    forest.unite(members[links[:, 0]], members[links[:, 1]])


def bucket_links(filed_key: np.ndarray, filed_fp: np.ndarray, looked_key: np.ndarray, looked_fp: np.ndarray) -> np.ndarray:
    """(k, 2) linked fingerprints: a spanning forest of the verified pairs of a bucket."""
    fps = np.unique(np.concatenate([filed_fp, looked_fp]))
    forest = Forest(len(fps))
    order = np.argsort(filed_key, kind="stable")
    filed_key, filed = filed_key[order], np.searchsorted(fps, filed_fp[order])
    looked = np.searchsorted(fps, looked_fp)
    first, last = np.searchsorted(filed_key, looked_key, "left"), np.searchsorted(filed_key, looked_key, "right")
    n = last - first
    for key in np.unique(looked_key[n > DENSE]):
        a, b = np.searchsorted(filed_key, key, "left"), np.searchsorted(filed_key, key, "right")
        link_dense(forest, fps, np.unique(np.concatenate([filed[a:b], looked[looked_key == key]])))
    here = np.flatnonzero((n > 0) & (n <= DENSE))
    ends = np.cumsum(n[here])
    start = 0
    while start < len(here):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + (1 << 21), "right")))
        part = here[start:stop]
        count = n[part]
        shift = np.repeat(first[part] - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
        a, b = np.repeat(looked[part], count), filed[np.arange(count.sum()) + shift]
        close = (a != b) & _near(fps[a], fps[b])
        a, b = a[close], b[close]
        apart = forest.classes()
        apart = apart[a] != apart[b]
        forest.unite(a[apart], b[apart])
        start = stop
    return fps[np.array(forest.links, np.int64).reshape(-1, 2)]


def fingerprints(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The kept long columns and ``fp``, the fingerprint as a signed long."""
    ddl = ", ".join([*(f"{c} long" for c in keep), "fp long"])
    schema = arrow_schema(ddl)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t) for t in texts(b.column(len(keep)))], np.uint64).view(np.int64)
            yield batch(schema, [*(b.column(k) for k in range(len(keep))), pa.array(fp)])

    return docs.select(*(F.col(c).cast("long").alias(c) for c in keep), F.col(text_col).cast("string").alias("_text")).mapInArrow(take, ddl)


def fingerprint_links(nodes: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) to links (a, b) that connect what lies within ``MOST_BITS``."""
    spark = nodes.sparkSession
    buckets = max(shuffle_partitions(spark), nodes.count() * 80 // BUCKET_KEYS + 1)
    packed = arrow_schema("bucket int, filed_key binary, filed_fp binary, looked_key binary, looked_fp binary")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sides = fuzzy_keys(b.column(0).to_numpy().view(np.uint64))
            parts: dict[int, list[bytes]] = {}
            for side in (0, 2):
                key, fp = sides[side].astype(np.uint32), sides[side + 1]
                to = key % np.uint32(buckets)
                order = np.argsort(to, kind="stable")
                key, fp, to = key[order], fp[order], to[order]
                edges = np.concatenate([[0], np.flatnonzero(to[1:] != to[:-1]) + 1, [len(to)]])
                for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    if e > s:
                        parts.setdefault(int(to[s]), [b""] * 4)[side : side + 2] = [key[s:e].tobytes(), fp[s:e].tobytes()]
            yield batch(packed, [list(parts), *([p[k] for p in parts.values()] for k in range(4))])

    links = arrow_schema("a long, b long")

    def link(group: pa.Table) -> pa.Table:
        joined = [b"".join(group.column(k).to_pylist()) for k in range(1, 5)]
        kinds = (np.uint32, np.uint64, np.uint32, np.uint64)
        found = bucket_links(*(np.frombuffer(j, k) for j, k in zip(joined, kinds, strict=True))).view(np.int64)
        return pa.table([pa.array(found[:, 0]), pa.array(found[:, 1])], schema=links)

    ddl = "bucket int, filed_key binary, filed_fp binary, looked_key binary, looked_fp binary"
    return nodes.select("fp").mapInArrow(pack, ddl).groupBy("bucket").applyInArrow(link, "a long, b long")


def near_groups(prints: DataFrame) -> DataFrame:
    """A written table with fp and a long ``doc_id`` to the same with ``root`` and ``component_id``."""
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-nodes")
    roots = components(fingerprint_links(nodes))
    known = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    known = written(known, "simhash-roots")
    least = known.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("of"))
    known = skew_lookup(known, least, "root", "of").select("fp", "n", "root", "component_id")
    return skew_lookup(prints, written(known, "simhash-components"), "fp", "n")


def simhash_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row."""
    prints = written(fingerprints(docs.select(F.col(id_col).alias("doc_id"), text_col), ["doc_id"], text_col), "simhash")
    return near_groups(prints).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the smallest id (null last, then the first read)."""
    rows, rid = numbered(docs)
    prints = written(fingerprints(rows.select(F.col(id_col).alias("doc_id"), F.col(rid).alias("rid"), text_col), ["doc_id", "rid"], text_col), "simhash")
    first = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "rid")).alias("first")
    stay = near_groups(prints).groupBy("root").agg(first).select(F.col("first.rid").alias(rid))
    return rows.join(stay, rid, "left_semi").drop(rid)
