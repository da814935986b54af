"""Substring dedup with FM-indexes over shards (operator 4).

A window is ``WINDOW`` consecutive words of a document.  Every word is removed
that a window covers whose words also start, in that order, in a document with
a smaller id.  The search runs in shards that are cut by content, so a window
only has to meet the one index that can hold its copies:

1. *Anchors.*  A window's anchor is the ``GRAM``-word run in it with the least
   hash, so equal windows have equal anchors.  Texts are read in blocks; a block
   sends each of its distinct anchors once, packed, to the bucket of its hash.
   Anchors that two blocks, or two documents of a block, hold come back.
2. *Segments.*  Windows with a repeated anchor, as maximal runs with one anchor,
   are the documents' segments.  Each distinct segment of a block goes once to
   its anchor's shard.  An anchor held by more than ``HOT`` blocks, which many
   different contexts could follow, is dealt window by window instead, each to
   the shard of its own words.
3. *Index.*  A shard folds equal segments of all blocks (keeping the smallest
   id), and indexes the distinct ones: Burrows-Wheeler transform, a wavelet
   matrix of bit vectors with rank counts, and for each suffix the number of its
   segment instead of its place.  All places of all segments stream past the
   index together, extended backward while their interval has more than one
   entry: their matching statistics, as far as the threshold.  What reaches
   ``WINDOW`` words gets the smallest id of its interval, and goes back to the
   block.
4. *Removal.*  A block joins the places above the threshold that a smaller id owns
   into intervals of words (``matched_intervals``) and takes those words out.

Hashes only choose where windows meet; the index compares words.  Nothing is
collected on the driver, a shard holds distinct content only, and the number of
shards follows the text's bytes.

Cases: a null text has no words; texts shorter than a window lose nothing; a very
long text is a block of its own; a document never loses words to itself, to
rows with its own id (repeated rows, ties) or to a larger id; null ids come
after all others and are equal to each other; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batch, release, shuffle_partitions, sliced, texts, written

WINDOW, GRAM = 13, 6
#: Text bytes of a block; blocks that make an anchor hot.
BLOCK_BYTES, HOT = 32 << 20, 24
#: Text bytes a shard; the number of shards follows the corpus.
SHARD_BYTES = 64 << 20
NO_ID = (1 << 63) - 1
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Segments(NamedTuple):
    """A text's runs of windows with one anchor: window start and end, and the anchor."""

    start: np.ndarray
    end: np.ndarray
    anchor: np.ndarray


def segments(words: list[bytes]) -> Segments:
    n = len(words) - WINDOW + 1
    if n < 1:
        none = np.empty(0, np.int64)
        return Segments(none, none, none.astype(np.uint64))
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    g = h[: len(h) - GRAM + 1].copy()
    for k in range(1, GRAM):
        g *= _MIX
        g ^= h[k : len(h) - GRAM + 1 + k]
    g ^= g >> np.uint64(33)
    g *= np.uint64(0xFF51AFD7ED558CCD)
    g ^= g >> np.uint64(33)
    at = np.arange(n) + np.lib.stride_tricks.sliding_window_view(g, WINDOW - GRAM + 1).argmin(axis=1)
    start = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    return Segments(start, np.append(start[1:], n), g[at[start]])


def _filed(anchors: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket (high half) and 31 bits of the hash, above a free flag bit.

    A chance clash within a bucket only sends a segment to be searched in vain.
    """
    return ((anchors >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | (anchors & np.uint64(0xFFFFFFFE))


def _pack(values: np.ndarray) -> bytes:
    """Sorted 32-bit values as zstd of their differences, byte by byte."""
    d = np.diff(values.astype(np.uint32), prepend=np.uint32(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpack(packed: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(raw.T).view(np.uint32).ravel(), dtype=np.uint64)


_BLOCKS = "block long, ids binary, words binary, bucket int, anchors binary"


def _read_blocks(docs: DataFrame, buckets: int, id_col: str, text_col: str) -> DataFrame:
    """A block's documents as one zstd text, a line each with single spaces; its anchors by bucket."""
    schema = arrow_schema(_BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = zstandard.ZstdCompressor(level=6).compress
        block = TaskContext.get().partitionId() << 32
        for b in sliced(batches, "text", BLOCK_BYTES):
            ids = np.array([NO_ID if i is None else i for i in b.column(0).to_pylist()], np.int64)
            joined, anchors = [], []
            for t in texts(b.column(1)):
                words = t.split()
                joined.append(b" ".join(words))
                anchors.append(np.unique(_filed(segments(words).anchor, buckets)))
            rows = [(block, ids.tobytes(), code(b"\n".join(joined)), None, None)]
            a, o = np.concatenate(anchors), np.repeat(ids, [len(x) for x in anchors])
            order = np.lexsort((o, a))
            a, o = a[order], o[order]
            first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.empty(0, int)
            if len(first):
                last = np.append(first[1:], len(a)) - 1
                a = a[first] | (o[first] != o[last]).astype(np.uint64)
                to = a >> np.uint64(32)
                edge = np.concatenate([[0], np.flatnonzero(to[1:] != to[:-1]) + 1, [len(to)]]).tolist()
                rows += [(block, None, None, int(to[s]), _pack(a[s:e] & np.uint64(0xFFFFFFFF))) for s, e in zip(edge[:-1], edge[1:], strict=True)]
            yield batch(schema, [list(c) for c in zip(*rows, strict=True)])
            block += 1

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _BLOCKS)


_REPEATED = "block long, bucket int, anchors binary"


def _repeated(group: pa.Table) -> pa.Table:
    """One bucket's anchors by block to those that repeat, by block; the flag now says hot."""
    packed = [_unpack(x) for x in group.column("anchors").to_pylist()]
    blocks = group.column("block").to_numpy()
    a = np.concatenate(packed)
    of = np.repeat(np.arange(len(packed)), [len(x) for x in packed])
    order = np.argsort(a, kind="stable")
    a, of = a[order], of[order]
    flag, a = a & np.uint64(1), a & ~np.uint64(1)
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    n = np.diff(np.append(first, len(a)))
    keep = np.repeat((n > 1) | (np.maximum.reduceat(flag, first) > 0), n)
    a, of = (a | np.repeat(n > HOT, n).astype(np.uint64))[keep], of[keep]
    order = np.argsort(of, kind="stable")
    a, of = a[order], of[order]
    edge = [*np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])).tolist(), len(of)] if len(of) else [0]
    bucket = group.column("bucket")[0].as_py()
    columns = [[blocks[of[s]] for s in edge[:-1]], [bucket] * (len(edge) - 1), [_pack(a[s:e]) for s, e in zip(edge[:-1], edge[1:], strict=True)]]
    return pa.Table.from_batches([batch(arrow_schema(_REPEATED), columns)])


_CUT = "block long, places binary, shard int, pick binary, owner binary, content binary"


def _documents(block: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    """Ids and joined words of a block's documents."""
    ids = np.frombuffer(block.column("ids")[0].as_py(), np.int64)
    return ids, zstandard.ZstdDecompressor().decompress(block.column("words")[0].as_py()).split(b"\n")


def _cut(shards: int):
    schema = arrow_schema(_CUT)

    def run(block: pa.Table, repeated: pa.Table) -> pa.Table:
        """A block's segments with a repeated anchor: distinct ones by shard, and their places (document, window, segment)."""
        if not block.num_rows or not repeated.num_rows:
            return schema.empty_table()
        known = np.sort(np.concatenate([_unpack(a) | np.uint64(k << 32) for k, a in zip(repeated.column("bucket").to_pylist(), repeated.column("anchors").to_pylist(), strict=True)]))
        plain, code = known & ~np.uint64(1), zstandard.ZstdCompressor(level=3).compress
        seen: dict[bytes, int] = {}
        owner: list[int] = []
        shard: list[int] = []
        places: list[tuple[int, int, int]] = []
        for d, (doc_id, words) in enumerate(zip(*_documents(block), strict=True)):
            tokens = words.split()
            seg = segments(tokens)
            filed = _filed(seg.anchor, shards)
            at = np.minimum(np.searchsorted(plain, filed), len(plain) - 1)
            hit = np.flatnonzero(plain[at] == filed)
            for s, e, k in zip(seg.start[hit].tolist(), seg.end[hit].tolist(), at[hit].tolist(), strict=True):
                hot = bool(known[k] & np.uint64(1))
                for p, q in ((i, i + 1) for i in range(s, e)) if hot else ((s, e),):
                    content = b" ".join(tokens[p : q + WINDOW - 1])
                    if (x := seen.setdefault(content, len(seen))) == len(owner):
                        owner.append(doc_id)
                        shard.append((xxhash.xxh64_intdigest(content) if hot else (int(plain[k]) * int(_MIX) & NO_ID) >> 20) % shards)
                    elif doc_id < owner[x]:
                        owner[x] = doc_id
                    places.append((d, p, x))
        content, mine = list(seen), np.array(owner, np.int64)
        to = np.array(shard, np.int64)
        order = np.argsort(to, kind="stable")
        rows = [(code(np.array(places, np.int32).tobytes()), None, None, None, None)] if places else []
        edge = np.concatenate([[0], np.flatnonzero(np.diff(to[order])) + 1, [len(order)]]).tolist() if len(order) else [0]
        for s, e in zip(edge[:-1], edge[1:], strict=True):
            part = order[s:e]
            rows.append((None, int(to[part[0]]), part.astype(np.int32).tobytes(), mine[part].tobytes(), code(b"\n".join([content[k] for k in part.tolist()]))))
        own = block.column("block")[0].as_py()
        return pa.Table.from_batches([batch(schema, [[own] * len(rows), *([list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 5)])])

    return run


class WaveletMatrix:
    """Symbols below ``2**levels`` as one bit vector a level, with rank counts every 64 bits."""

    def __init__(self, symbols: np.ndarray, levels: int) -> None:
        self.n, self.levels = len(symbols), levels
        self.bits, self.ranks, self.zeros = [], [], []
        s = symbols
        for level in range(levels - 1, -1, -1):
            one = (s >> level & 1).astype(bool)
            packed = np.packbits(np.concatenate([one, np.zeros(-len(one) % 64 + 64, bool)]), bitorder="little").view(np.uint64)
            self.bits.append(packed)
            self.ranks.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]).astype(np.uint32 if self.n < 1 << 32 else np.int64))
            self.zeros.append(int(self.n - one.sum()))
            s = np.concatenate([s[~one], s[one]])

    def place(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where the occurrences of ``symbol`` among the first ``i`` entries end in the last level."""
        for k in range(self.levels):
            word, bit = i >> 6, (i & 63).astype(np.uint64)
            ones = self.ranks[k][word].astype(np.int64) + np.bitwise_count(self.bits[k][word] & ((np.uint64(1) << bit) - np.uint64(1)))
            i = np.where(symbol >> (self.levels - 1 - k) & 1, self.zeros[k] + ones, i - ones)
        return i


class FmIndex:
    """Backward search over texts of symbols; 0 stands between texts and is in no pattern.

    Once built it holds bit vectors with 32-bit counts, and instead of suffixes
    (places in the text) the 32-bit label of the text each of them begins in.
    """

    def __init__(self, text: np.ndarray, symbols: int, labels: np.ndarray, depth: int = WINDOW) -> None:
        n = len(text)
        rank, step = text.astype(np.int64), 1
        order = np.argsort(rank, kind="stable")
        while step < depth:  # suffixes sorted by their first ``step`` symbols
            ahead = np.zeros(n, np.int64)
            ahead[: n - step] = rank[step:] + 1 if n > step else 0
            key = rank * (n + symbols + 2) + ahead
            order = np.argsort(key, kind="stable")
            new = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
            rank = np.empty(n, np.int64)
            rank[order] = new
            step *= 2
        self.labels = labels.astype(np.int32)[order]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.tree = WaveletMatrix(text[order - 1], max(1, int(symbols - 1).bit_length()))
        every = np.arange(symbols)
        self.base = self.tree.place(every, np.zeros(symbols, np.int64))

    def back(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of ``symbol`` followed by what the intervals stand for."""
        shift = self.first[symbol] - self.base[symbol]
        return self.tree.place(symbol, low) + shift, self.tree.place(symbol, high) + shift

    def matches(self, ends: np.ndarray, text: np.ndarray, least: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the patterns ``text[end - least : end]``: those found twice or more, with their intervals.

        Matching statistics capped at ``least``: a search that is down to one
        entry has a longest repeated match below ``least`` and is dropped.
        """
        here = np.arange(len(ends))
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), len(text), np.int64)
        for k in range(1, least + 1):
            low, high = self.back(text[ends[here] - k], low, high)
            more = high - low > 1
            here, low, high = here[more], low[more], high[more]
        return here, low, high


def index_owners(contents: list[bytes], owners: np.ndarray) -> list[np.ndarray]:
    """Of every window of distinct segments: the smallest owner of the segments that hold its words."""
    ids: dict[bytes, int] = {}
    split = [c.split(b" ") for c in contents]
    lengths = np.array([len(s) for s in split])
    text = np.zeros(lengths.sum() + len(split) + 1, np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1] + 1
    for s, words in zip(starts.tolist(), split, strict=True):
        text[s : s + len(words)] = [ids.setdefault(w, len(ids) + 1) for w in words]
    of = np.zeros(len(text), np.int64)
    of[starts] = 1
    of = np.maximum(np.cumsum(of) - 1, 0)
    index = FmIndex(text, len(ids) + 1, of)
    windows = lengths - WINDOW + 1
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(windows)[:-1]]), windows) + np.arange(windows.sum())
    best = owners[of[at]].copy()
    here, low, high = index.matches(at + WINDOW, text)
    if len(here):
        unique, back = np.unique(low, return_inverse=True)
        end = np.empty(len(unique), np.int64)
        end[back] = high
        by_suffix = np.append(owners[index.labels], NO_ID)
        least = np.minimum.reduceat(by_suffix, np.stack([unique, end], axis=1).ravel())[::2]
        best[here] = np.minimum(best[here], least[back])
    return np.split(best, np.cumsum(windows)[:-1])


_OWNED = arrow_schema("block long, places binary, pick binary, counts binary, owners binary")


def _search(group: pa.Table) -> pa.Table:
    """One shard's segments by block to the owners of their windows, by block."""
    seen: dict[bytes, int] = {}
    decode = zstandard.ZstdDecompressor().decompress
    picks = [[seen.setdefault(c, len(seen)) for c in decode(row).split(b"\n")] for row in group.column("content").to_pylist()]
    owners = np.full(len(seen), NO_ID, np.int64)
    for p, o in zip(picks, group.column("owner").to_pylist(), strict=True):
        np.minimum.at(owners, p, np.frombuffer(o, np.int64))
    found = index_owners(list(seen), owners)
    code = zstandard.ZstdCompressor(level=3).compress
    counts = [np.array([len(found[k]) for k in p], np.int32).tobytes() for p in picks]
    packed = [code(np.concatenate([found[k] for k in p]).tobytes()) for p in picks]
    return pa.table([group.column("block").combine_chunks(), pa.nulls(len(counts), pa.binary()), group.column("pick").combine_chunks(), pa.array(counts, pa.binary()), pa.array(packed, pa.binary())], schema=_OWNED)


_REMOVED = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<int>, kept_text binary"


def _remove(with_text: bool):
    schema = arrow_schema(_REMOVED)

    def run(block: pa.Table, right: pa.Table) -> pa.Table:
        """A block's documents without the words of windows that a smaller id owns."""
        decode = zstandard.ZstdDecompressor().decompress
        owners: dict[int, np.ndarray] = {}
        places = np.empty((0, 3), np.int32)
        for w, p, c, o in zip(*(right.column(k).to_pylist() for k in ("places", "pick", "counts", "owners")), strict=True):
            if w is not None:
                places = np.frombuffer(decode(w), np.int32).reshape(-1, 3)
                continue
            parts = np.split(np.frombuffer(decode(o), np.int64), np.cumsum(np.frombuffer(c, np.int32))[:-1])
            owners.update(zip(np.frombuffer(p, np.int32).tolist(), parts, strict=True))
        ids, joined = _documents(block)
        of = np.searchsorted(places[:, 0], np.arange(len(ids) + 1))
        rows = []
        for d, (doc_id, words) in enumerate(zip(ids.tolist(), joined, strict=True)):
            tokens, change = words.split(), []
            if of[d] < of[d + 1]:
                edge = np.zeros(len(tokens) + 1, np.int32)
                for _, s, k in places[of[d] : of[d + 1]].tolist():
                    taken = s + np.flatnonzero(owners[k] < doc_id)
                    edge[taken] += 1
                    edge[taken + WINDOW] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                change = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))).tolist()
                words = b" ".join([tokens[k] for k in np.flatnonzero(~gone).tolist()]) if change else words
            removed = sum(change[1::2]) - sum(change[::2])
            rows.append((None if doc_id == NO_ID else doc_id, len(tokens), removed, hashlib.sha256(words).hexdigest(), change, words if with_text else None))
        return pa.Table.from_batches([batch(schema, [list(c) for c in zip(*rows, strict=True)])])

    return run


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans[, kept_text]) for every row.

    ``spans`` holds the removed word positions as start, end, start, end, ...
    """
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    parts = max(shuffle_partitions(docs.sparkSession), size // SHARD_BYTES, 1)
    blocks = written(_read_blocks(docs, parts, id_col, text_col), "substring-blocks")
    rows = blocks.where("ids is not null").select("block", "ids", "words").groupBy("block")
    repeated = blocks.where("bucket is not null").select("block", "bucket", "anchors").groupBy("bucket").applyInArrow(_repeated, _REPEATED)
    cut = written(rows.cogroup(repeated.groupBy("block")).applyInArrow(_cut(parts), _CUT), "substring-segments")
    release(docs.sparkSession)
    owned = cut.where("shard is not null").select("shard", "block", "pick", "owner", "content").groupBy("shard").applyInArrow(_search, "block long, places binary, pick binary, counts binary, owners binary")
    none = F.lit(None).cast("binary")
    places = cut.where("places is not null").select("block", "places", none.alias("pick"), none.alias("counts"), none.alias("owners"))
    out = rows.cogroup(places.unionByName(owned).groupBy("block")).applyInArrow(_remove(with_text), _REMOVED)
    return out.withColumn("kept_text", F.decode("kept_text", "UTF-8")) if with_text else out.drop("kept_text")


def matched_intervals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, stop): word intervals of ``WINDOW`` words or more that smaller ids hold too, joined where they touch."""
    pairs = F.expr("transform(sequence(0, size(spans) div 2 - 1), k -> struct(spans[cast(2 * k as int)] AS start, spans[cast(2 * k + 1 as int)] AS stop))")
    return repeated_words(docs, id_col, text_col).where(F.size("spans") > 0).select("doc_id", F.explode(pairs).alias("i")).select("doc_id", "i.*")


def substring_report(docs: DataFrame) -> DataFrame:
    return repeated_words(docs).drop("spans")


ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce("text", ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)),
m AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS o FROM s) WHERE o < doc_id),
c AS (SELECT DISTINCT doc_id, i + unnest(range({WINDOW})) AS p FROM m),
k AS (SELECT d.doc_id, p, w[p] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d) d ANTI JOIN c USING (doc_id, p)),
t AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM k GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""
