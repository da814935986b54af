"""SentencePiece encoding and decoding with seeded merge-dropout (operator 7).

The merges of a given SentencePiece BPE model are applied from an agenda, best
score first and leftmost among equals.  A candidate that comes up is skipped
when a keyed hash of (seed, doc_id, cut, place, piece) falls below ``p``; it
can come up again once a neighbour has merged.  So the segmentation varies,
every piece is of the vocabulary, and decoding gives the text back whole.  With
``p = 0`` the pieces are the model's own.

Text is coded as it is: one space goes in front, spaces are the model's space
mark, and what the vocabulary lacks, a literal space mark included, goes as
bytes.  No merge crosses from a word into the next space, nor a line end that no
piece holds, so a text is cut there, and every cut of every document draws for
itself.  What a cut's candidates are
depends on the draws before alone, so a worker remembers each word as a tree: a
candidate, and what follows if it is merged or skipped, down to the codes.  Only
the hash is drawn anew.  A way met for the first time and once is coded without
growing a tree; trees that have grown over ``REMEMBERED`` are dropped.

Cases: null and empty texts have no ids and decode to the empty text; a very long
text is coded in one go with a key a cut, and a cut over ``LONGEST`` characters on
its own, never remembered; of equal scores the leftmost merges first; repeated
rows with one doc_id are coded alike unless ``copy_col`` numbers them; a null id draws like id -1; ids do not
depend on partitioning, order or executor; an empty table gives an empty
result; other columns stay in ``encode_docs``, and of names that clash in any case
the new one gets ``_`` behind.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, sliced, texts

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT, SEED, REMEMBERED = 0.1, 7, 8_000_000
#: Cuts of at most so many known characters are merged together, many at a time; others one by one.
SHORT, TOGETHER = 32, 8192
#: Longer cuts are not remembered.
LONGEST = 64
_NONE = 1 << 30
#: Codes that are met once are numbered from here.
_ONCE = 1 << 40
#: Text bytes coded at a time.
SLICE_BYTES = 2 << 20
MARK = "▁"
#: Characters that part cuts where no piece holds them.
BREAKS = "\n\r\t"
_M = (1 << 64) - 1
_A, _B, _C = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


class Pieces:
    """A BPE vocabulary and its merge-dropout coder; small, and sent to the workers."""

    def __init__(self, model_file: str = MODEL, p: float = DROPOUT, seed: int = SEED) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.p, self.seed, self.least = p, seed, min(int(p * 2**64), _M)
        self.ids: dict[str, int] = {}
        scores: dict[str, float] = {}
        self.byte_ids = [0] * 256
        self.bytes_of: list[bytes] = []
        for k in range(sp.get_piece_size()):
            piece = sp.id_to_piece(k)
            if sp.is_byte(k):
                self.byte_ids[int(piece[3:-1], 16)] = k
                self.bytes_of.append(bytes([int(piece[3:-1], 16)]))
            elif sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k):
                self.bytes_of.append(b"")
            else:
                self.ids[piece], scores[piece] = k, -sp.get_score(k)
                self.bytes_of.append(piece.replace(MARK, " ").encode())
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece crosses from a word into the next space")
        parted = "".join(c for c in BREAKS if not any(c in q for q in self.ids))
        #: Spaces with what follows them, runs of breaks, and what follows a break.
        self.cut = re.compile(f" +[^ {parted}]*|[{parted}]+|[^ {parted}]+" if parted else " +[^ ]*")
        order = {x: k for k, x in enumerate(sorted(set(scores.values())))}
        #: Place of each piece in the order of merging; equal scores have equal ranks.
        self.ranks = {p: order[x] for p, x in scores.items()}
        pairs = sorted((self.ids[q[:k]] * len(self.bytes_of) + self.ids[q[k:]], i, self.ranks[q]) for q, i in self.ids.items() for k in range(1, len(q)) if q[:k] in self.ids and q[k:] in self.ids)
        #: Pairs of pieces that make a piece: sorted keys, the piece, its rank.
        self.pairs = tuple(np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self._forget()

    def _forget(self) -> None:
        self._clear()
        self._bytes: pa.BinaryArray | None = None
        self._char = np.full(0x110000, -1, np.int32)
        for piece, k in self.ids.items():
            if len(piece) == 1 and piece != MARK:
                self._char[ord(piece)] = k
        self._char[ord(" ")] = self.ids[MARK]

    def _clear(self) -> None:
        """No trees: a step is a candidate and, merged and skipped, the next step; under -1 there are codes, -1 is not known."""
        self._roots: dict[str, int] = {}
        self._seen: set[str] = set()
        self._mixed, self._next = array("Q"), array("q")
        self._start, self._size, self._codes = array("q"), array("q"), array("i")
        self._pass()

    def _pass(self) -> None:
        """No ways that are met once: those live as long as the texts they are met in."""
        self._start_once, self._size_once, self._codes_once = array("q"), array("q"), array("i")

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_char", "_bytes", "_roots", "_seen", "_mixed", "_next", "_start", "_size", "_codes", "_start_once", "_size_once", "_codes_once")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._forget()

    def _code(self, cut: str, key: int) -> tuple[list[int], list[int], list[bool]]:
        """Ids of one cut, its candidates and which were skipped: a symbol for each character, then merges from the agenda."""
        # A literal space mark must not take part as the model's: it stands apart under NUL.
        symbols = [MARK if c == " " else "\0" + c if c == MARK else c for c in cut]
        ids: list[int] = []
        merged, mixed, skipped = self._merged(symbols, key)
        for s in merged:
            if (k := self.ids.get(s)) is not None:
                ids.append(k)
            else:
                ids += [self.byte_ids[x] for x in (s[1:] if len(s) > 1 and s[0] == "\0" else s).encode()]
        return ids, mixed, skipped

    def _merged(self, sym: list[str], key: int) -> tuple[list[str], list[int], list[bool]]:
        """The symbols after all merges, for a cut of any length: the agenda is a heap, the symbols are linked."""
        ranks, n = self.ranks, len(sym)
        mixed: list[int] = []
        skipped: list[bool] = []
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(r, k, k + 1, a + b) for k, (a, b) in enumerate(zip(sym, sym[1:], strict=False)) if (r := ranks.get(a + b)) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, a, b, piece = heapq.heappop(agenda)
            if not sym[a] or not sym[b] or right[a] != b or sym[a] + sym[b] != piece:
                continue
            mixed.append((a * _A + self.ids[piece] * _B) & _M)
            h = ((key ^ mixed[-1]) * _C) & _M
            skipped.append(((h ^ h >> 29) * _B & _M) < self.least)
            if skipped[-1]:
                continue
            sym[a], sym[b] = piece, ""
            right[a] = r = right[b]
            if r < n:
                left[r] = a
                if (m := ranks.get(piece + sym[r])) is not None:
                    heapq.heappush(agenda, (m, a, r, piece + sym[r]))
            if (q := left[a]) >= 0 and (m := ranks.get(sym[q] + piece)) is not None:
                heapq.heappush(agenda, (m, q, a, sym[q] + piece))
        return [s for s in sym if s], mixed, skipped

    def _pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece and rank that neighbours make (rank ``_NONE``: none)."""
        keys, piece, rank = self.pairs
        q = a.astype(np.int64) * len(self.bytes_of) + b
        at = np.minimum(np.searchsorted(keys, q), len(keys) - 1)
        made = (keys[at] == q) & (a >= 0) & (b >= 0)
        return np.where(made, piece[at], -1), np.where(made, rank[at], _NONE)

    def _merged_together(self, rows: np.ndarray, keys: np.ndarray, steps: bool) -> tuple[list[int], list[int], list[int], list[bool], list[int]]:
        """``_code`` for many cuts at once, a row of piece ids each, -1 behind: a row's agenda is its line of ranks.

        The ids of all and the end of each, and if asked for its ``steps``, the candidates, the skipped and the end of each.
        """
        n, wide = len(rows), rows.shape[1] + 1
        sym = np.concatenate([rows, np.full((n, 1), -1)], axis=1)  # one column of nothing ends every row
        right = np.minimum(np.arange(1, wide + 1), wide - 1) + np.zeros((n, 1), np.int64)
        left = np.arange(-1, wide - 1) + np.zeros((n, 1), np.int64)
        piece, rank = np.full((n, wide), -1, np.int64), np.full((n, wide), _NONE, np.int64)
        piece[:, :-1], rank[:, :-1] = self._pair(sym[:, :-1], sym[:, 1:])
        live, none = np.arange(n), np.zeros(0, np.int64)
        done: list[tuple[np.ndarray, ...]] = [(none, none.astype(np.uint64), none.astype(bool))]
        while len(live):
            at = rank[live].argmin(axis=1)
            more = rank[live, at] < _NONE
            live, at = live[more], at[more]
            made = piece[live, at]
            mixed = at.astype(np.uint64) * np.uint64(_A) + made.astype(np.uint64) * np.uint64(_B)
            skip = self._skips(keys[live], mixed)
            if steps:
                done.append((live, mixed, skip))
            rank[live[skip], at[skip]] = _NONE
            row, k, made = live[~skip], at[~skip], made[~skip]
            gone = right[row, k]
            after, before = right[row, gone], left[row, k]
            sym[row, k], sym[row, gone], rank[row, gone] = made, -1, _NONE
            right[row, k], left[row, after] = after, k
            piece[row, k], rank[row, k] = self._pair(made, np.where(after > k, sym[row, after], -1))
            has = before >= 0
            r, p = row[has], before[has]
            piece[r, p], rank[r, p] = self._pair(sym[r, p], made[has])
        of, mixed, skip = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(of, kind="stable")
        return sym[sym >= 0].tolist(), np.cumsum((sym >= 0).sum(axis=1)).tolist(), mixed[order].tolist(), skip[order].tolist(), np.cumsum(np.bincount(of, minlength=n)).tolist()

    def _skips(self, keys: np.ndarray, mixed: np.ndarray) -> np.ndarray:
        h = (keys ^ mixed) * np.uint64(_C)
        return (h ^ h >> np.uint64(29)) * np.uint64(_B) < np.uint64(self.least)

    def _leaf(self, ids: list[int]) -> int:
        self._start.append(len(self._codes))
        self._size.append(len(ids))
        self._codes.extend(ids)
        return -1 - len(self._start)

    def _leaf_once(self, ids: list[int]) -> int:
        self._start_once.append(len(self._codes_once))
        self._size_once.append(len(ids))
        self._codes_once.extend(ids)
        return -1 - _ONCE - len(self._start_once)

    def _grow(self, cut: str, ids: list[int], mixed: list[int], skipped: list[bool]) -> None:
        """Add a cut's way to its codes to its tree."""
        at, edge = self._roots.get(cut, -1), -1
        for m, s in zip(mixed, skipped, strict=True):
            if at == -1:
                at = self._link(cut, edge, len(self._mixed))
                self._mixed.append(m)
                self._next.extend((-1, -1))
            edge = 2 * at + s
            at = self._next[edge]
        if at == -1:
            self._link(cut, edge, self._leaf(ids))

    def _link(self, cut: str, edge: int, to: int) -> int:
        if edge < 0:
            self._roots[cut] = to
        else:
            self._next[edge] = to
        return to

    def _learn(self, cuts: list[str], keys: np.ndarray, grow: bool) -> list[int]:
        """Code cuts as their keys draw: into their trees, or as codes of their own, whose places are returned."""
        out = [-1] * len(cuts)
        order = sorted(range(len(cuts)), key=lambda j: len(cuts[j]))
        for k in range(0, len(order), TOGETHER):
            part = order[k : k + TOGETHER]
            short = [j for j in part if len(cuts[j]) <= SHORT]
            alone = part[len(short) :]
            if short:
                lengths = np.array([len(cuts[j]) for j in short])
                there = np.arange(lengths[-1]) < lengths[:, None]
                rows = np.full(there.shape, -1, np.int64)
                rows[there] = self._char[np.frombuffer("".join([cuts[j] for j in short]).encode("utf-32-le"), np.uint32)]
                odd = ((rows < 0) & there).any(axis=1)
                plain = np.flatnonzero(~odd)
                alone += [short[j] for j in np.flatnonzero(odd).tolist()]
                short = [short[j] for j in plain.tolist()]
                flat, ends, mixed, skipped, stops = self._merged_together(rows[plain], keys[short], grow)
                if grow:
                    for j, a, b, c, d in zip(short, [0, *ends], ends, [0, *stops], stops, strict=False):
                        self._grow(cuts[j], flat[a:b], mixed[c:d], skipped[c:d])
                else:
                    base, leaf = len(self._codes_once), -2 - _ONCE - len(self._start_once)
                    self._codes_once.extend(flat)
                    self._start_once.extend(base + a for a in [0, *ends[:-1]][: len(ends)])
                    self._size_once.extend(b - a for a, b in zip([0, *ends], ends, strict=False))
                    for i, j in enumerate(short):
                        out[j] = leaf - i
            for j in alone:
                way = self._code(cuts[j], int(keys[j]))
                if grow:
                    self._grow(cuts[j], *way)
                else:
                    out[j] = self._leaf_once(way[0])
        return out

    def _walk(self, at: np.ndarray, keys: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lead the live cuts down their trees; those whose next step is not known, and the edge to it."""
        if not len(live) or not self._mixed:
            return live[:0], live[:0]
        mixed, next_ = np.frombuffer(self._mixed, np.uint64), np.frombuffer(self._next, np.int64)
        lost, edges = [], []
        live = live[at[live] >= 0]
        while len(live):
            edge = 2 * at[live] + self._skips(keys[live], mixed[at[live]])
            to = next_[edge]
            if (gone := to == -1).any():
                lost.append(live[gone])
                edges.append(edge[gone])
                live, to = live[~gone], to[~gone]
            at[live] = to
            live = live[to >= 0]
        return (np.concatenate(lost), np.concatenate(edges)) if lost else (live, live)

    def _keys(self, doc_id: int | None, copy: int, n: int) -> np.ndarray:
        """The key of each of a text's cuts (splitmix64 of a keyed start)."""
        start = xxhash.xxh64_intdigest(b"%d" % (-1 if doc_id is None else doc_id) + (b" %d" % copy if copy else b""), self.seed)
        h = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_A) + np.uint64(start)
        h = (h ^ h >> np.uint64(30)) * np.uint64(_B)
        h = (h ^ h >> np.uint64(27)) * np.uint64(_C)
        return h ^ h >> np.uint64(31)

    def encode_flat(self, texts_: list[str], doc_ids: list[int | None], copies: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's start and the last's end; unknown ways of all of them are coded together."""
        by_text = [self.cut.findall(" " + t) if t else [] for t in texts_]
        counts = np.array([len(c) for c in by_text], np.int64)
        cuts = list(chain.from_iterable(by_text))
        if not cuts:
            return np.zeros(0, np.int32), np.zeros(len(texts_) + 1, np.int64)
        keys = np.concatenate([self._keys(i, c, n) for i, c, n in zip(doc_ids, copies or [0] * len(texts_), counts.tolist(), strict=True)])
        roots, seen = self._roots, self._seen
        at = np.array([roots.get(c, -1) for c in cuts], np.int64)
        new = np.flatnonzero(at == -1).tolist()
        times = Counter(cuts[j] for j in new)
        often = {c for c, n in times.items() if len(c) <= LONGEST and (n > 1 or c in seen)}
        seen.update(c for c in times if c not in often and len(c) <= LONGEST)
        first = list({cuts[j]: j for j in new if cuts[j] in often}.values())
        self._learn([cuts[j] for j in first], keys[first], True)
        once = [j for j in new if cuts[j] not in often]
        at[new] = [roots.get(cuts[j], -1) for j in new]
        at[once] = self._learn([cuts[j] for j in once], keys[once], False)
        lost, edges = self._walk(at, keys, np.arange(len(cuts)))
        while len(lost):
            _, first, which, n = np.unique(edges, return_index=True, return_inverse=True, return_counts=True)
            first = lost[first[n > 1]]
            once = lost[n[which] == 1]
            self._learn([cuts[j] for j in first.tolist()], keys[first], True)
            at[once] = self._learn([cuts[j] for j in once.tolist()], keys[once], False)
            lost, edges = self._walk(at, keys, lost)
        leaf = -2 - at
        leaf = np.where(leaf < _ONCE, leaf, leaf - _ONCE + len(self._start))
        sizes, starts = (np.concatenate([np.frombuffer(x, np.int64), np.frombuffer(y, np.int64) + more]) for x, y, more in ((self._size, self._size_once, 0), (self._start, self._start_once, len(self._codes))))
        size, start = sizes[leaf], starts[leaf]
        ends = np.concatenate([[0], np.cumsum(size)])
        codes = np.concatenate([np.frombuffer(self._codes, np.int32), np.frombuffer(self._codes_once, np.int32)])
        ids = codes[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])]
        self._pass()
        if len(self._mixed) + len(self._codes) + len(seen) > REMEMBERED:
            self._clear()
        return ids, ends[np.concatenate([[0], np.cumsum(counts)])]

    def encode_many(self, texts_: list[str], doc_ids: list[int | None], copies: list[int] | None = None) -> list[list[int]]:
        """Ids of each text."""
        ids, ends = self.encode_flat(texts_, doc_ids, copies)
        flat, ends = ids.tolist(), ends.tolist()
        return [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def encode(self, text: str, doc_id: int | None) -> list[int]:
        return self.encode_many([text], [doc_id])[0]

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode()[1:]

    def decode_flat(self, ids: np.ndarray, ends: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """The bytes that all ids stand for, each text with its leading space, and where each text starts and the last ends."""
        if self._bytes is None:
            self._bytes = pa.array(self.bytes_of, pa.binary())
        taken = self._bytes.take(pa.array(ids))
        _, offsets, data = taken.buffers()
        at = np.frombuffer(offsets, np.int32)[taken.offset : taken.offset + len(taken) + 1] if len(taken) else np.zeros(1, np.int32)
        return memoryview(data or b"").cast("B"), at[ends]

    def lossless(self, given: list[bytes], ids: np.ndarray, ends: np.ndarray) -> list[bool]:
        """Whether each text's ids decode to it, byte for byte."""
        data, at = self.decode_flat(ids, ends)
        sizes = np.fromiter((len(t) + 1 if t else 0 for t in given), np.int64, len(given))
        if np.array_equal(np.diff(at), sizes) and data[at[0] : at[-1]] == b"".join([b" " + t for t in given if t]):
            return [True] * len(given)
        return [bytes(data[a:b]) == (b" " + t if t else b"") for t, a, b in zip(given, at.tolist(), at[1:].tolist(), strict=False)]


def encode_docs(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text", copy_col: str | None = None) -> DataFrame:
    """All columns of ``docs`` but ``copy_col`` with ``piece_ids``, ``n_pieces`` and ``lossless`` (names that clash get ``_`` behind)."""
    kept = [f for f in docs.schema.fields if f.name != copy_col]
    names = []
    for name in ("piece_ids", "n_pieces", "lossless"):
        names.append(free_name([*docs.columns, *names], name))
    out = T.StructType([*kept, T.StructField(names[0], T.ArrayType(T.IntegerType())), T.StructField(names[1], T.LongType()), T.StructField(names[2], T.BooleanType())])
    sent = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        for b in batches:
            for part in sliced(iter([b]), text_col, SLICE_BYTES):
                names_in = part.schema
                raw = texts(part.column(names_in.get_field_index(text_col)))
                given = [t.decode() for t in raw]
                copies = part.column(names_in.get_field_index(copy_col)).to_pylist() if copy_col else None
                ids, ends = p.encode_flat(given, part.column(names_in.get_field_index(id_col)).cast(pa.int64()).to_pylist(), copies)
                whole = p.lossless(raw, ids, ends)
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                columns = [*(part.column(names_in.get_field_index(f.name)) for f in kept), lists, pa.array(np.diff(ends)), pa.array(whole, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in kept), *names])

    return docs.mapInArrow(run, out)


def decode_docs(encoded: DataFrame, pieces: Pieces, ids_col: str = "piece_ids", text_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text its ids stand for in ``text_col``."""
    out = T.StructType([f for f in encoded.schema.fields if f.name != text_col] + [T.StructField(text_col, T.StringType())])
    sent = encoded.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [sent.value.decode(x or ()) for x in b.column(b.schema.get_field_index(ids_col)).to_pylist()]
            left = [k for k, n in enumerate(b.schema.names) if n != text_col]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in left), pa.array(got, pa.string())], names=[*(b.schema.names[k] for k in left), text_col])

    return encoded.mapInArrow(run, out)


def sentencepiece_report(docs: DataFrame, model_file: str = MODEL) -> DataFrame:
    """(doc_id, piece_ids, n_pieces, lossless) for every row."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return encode_docs(narrow, Pieces(model_file)).drop("text")
