"""SentencePiece encoding and decoding by a unigram model.

A text's spaces become whitespace markers (U+2581) and one is put in front.  The encoder takes
the pieces of highest total log score: all pieces that start at a character are found by
one walk through a double-array trie, and a Viterbi pass joins them.  A character that no
piece covers costs the lowest score less PENALTY and is written as its UTF-8 bytes' pieces.
Of equal sums the one whose last piece is longest wins, as in the library.

The model's own settings hold: whether a marker is put in front, whether extra spaces go (then a text may not decode to itself), and
user-defined pieces, which outdo others by the library's rule.  A model with a character map is refused.

No piece holds a marker after another character, so a run of markers always begins a
new segment; segments are solved apart, once for each distinct one, many at a time.

The model file is data: its pieces and scores are read, nothing is trained.  A file of kind
unigram has log scores.  A file of kind BPE has merge ranks instead, which say how common a piece
is but are no log scores; rank r is read as the Zipf log probability -ln(r + ZIPF_SHIFT), in steps
of 1/1024 so that sums are exact.

Null and empty texts have no ids and decode to an empty text.  A text that holds the marker
itself decodes to a space there (round_trip false), as in the library.  A very long text is held whole by one task, its segments
are solved in blocks; one segment without spaces is solved at once.  Rows that share a doc_id are kept apart; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_process, slices, texts

MARK = "▁"
# Kinds of pieces and of models in a SentencePiece model file, its unknown penalty and the cost of a user-defined piece.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
PENALTY, USER_COST = 10.0, 0.1
ZIPF_SHIFT = 2
#: Segments that a worker remembers.
REMEMBERED = 150_000
_RUNS = re.compile(" +[^ ]*")
_SPACES = re.compile("  +")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield key >> 3, data[at : at + size]
        at += size


@dataclass
class Settings:
    """The model's kind, whether a marker is put in front, and whether spaces at the ends and repeated ones go."""

    model: int = UNIGRAM
    prefix: bool = True
    squeeze: bool = True


def read_settings(file: str) -> Settings:
    out = Settings()
    with open(file, "rb") as f:
        for number, value in _fields(f.read()):
            if number == 2:
                own = dict(_fields(value))
                out.model = own.get(3, UNIGRAM)
                if own.get(24, 0):
                    raise ValueError("markers after words are not supported")
            elif number == 3:
                own = dict(_fields(value))
                if own.get(2):
                    raise ValueError("the model has a character map")
                out.prefix, out.squeeze = bool(own.get(3, 1)), bool(own.get(4, 1))
                if not own.get(5, 1):
                    raise ValueError("spaces that are no markers are not supported")
    return out


def read_model(file: str) -> tuple[list[tuple[str, float, int]], Settings]:
    """Pieces with score and kind, in id order, and the settings."""
    with open(file, "rb") as f:
        data = f.read()
    pieces = []
    for number, value in _fields(data):
        if number == 1:
            own = dict(_fields(value))
            pieces.append((own.get(1, b"").decode(), float(np.frombuffer(own[2], "<f4")[0]) if 2 in own else 0.0, own.get(3, NORMAL)))
    return pieces, read_settings(file)


def log_scores(pieces: list[tuple[str, float, int]], model: int) -> np.ndarray:
    if model == BPE:
        return np.array([round(-math.log(max(0.0, -s) + ZIPF_SHIFT) * 1024) / 1024 for _, s, _ in pieces])
    return np.array([s for _, s, _ in pieces])


@dataclass
class Trie:
    """A double array: the child of node s by byte c is t = base[s] + c + 1 if check[t] == s; value[t]: a piece's id or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray


def build_trie(keys: list[tuple[bytes, int]]) -> Trie:
    children: list[dict[int, int]] = [{}]
    values = [-1]
    for key, ident in keys:
        node = 0
        for c in key:
            if (to := children[node].get(c)) is None:
                to = children[node][c] = len(children)
                children.append({})
                values.append(-1)
            node = to
        values[node] = ident
    # Bases first, nodes of many children before those of few; then checks, once every node has its place.
    window, spare = 4096, 8192 + 258
    free = np.ones(len(children) + spare, bool)
    free[0] = False
    bases, at, last = {}, 0, 0
    kids_of = sorted((n for n, kids in enumerate(children) if kids), key=lambda n: -len(children[n]))
    several = [n for n in kids_of if len(children[n]) > 1]
    for node, count in zip(several, (len(children[n]) for n in several), strict=True):
        if bases and count < len(children[last]):
            at = 0  # fewer children fit into earlier gaps
        last, offsets = node, [c + 1 for c in children[node]]
        while True:
            if at + window + 258 > len(free):
                free = np.append(free, np.ones(len(free), bool))
            fits = free[at + offsets[0] : at + offsets[0] + window].copy()
            for o in offsets[1:]:
                fits &= free[at + o : at + o + window]
            if fits.any():
                at += int(fits.argmax())
                break
            at += window
        bases[node] = at
        free[[at + o for o in offsets]] = False
    slots = iter(np.flatnonzero(free[257:]) + 257)
    for node in kids_of[len(several) :]:
        (c,) = children[node]
        slot = int(next(slots, 0)) or len(free)
        if slot == len(free):
            free = np.append(free, np.zeros(1, bool))
        free[slot] = False
        bases[node] = slot - c - 1
    place = np.zeros(len(children), np.int64)
    for node, base in bases.items():
        for c, kid in children[node].items():
            place[kid] = base + c + 1
    end = int(max(place.max(), max(bases.values(), default=0))) + 258
    out = Trie(np.zeros(end, np.int32), np.full(end, -1, np.int32), np.full(end, -1, np.int32))
    out.value[place] = values
    for node, base in bases.items():
        out.base[place[node]] = base
        for kid in children[node].values():
            out.check[place[kid]] = place[node]
    return out


class Unigram:
    """An encoder and decoder of one vocabulary."""

    def __init__(self, pieces: list[tuple[str, float, int]], settings: Settings):
        self.settings, self.scores = settings, log_scores(pieces, settings.model)
        self.kinds = np.array([k for *_, k in pieces], np.int32)
        usable = [(p.encode(), i) for i, (p, _, k) in enumerate(pieces) if k in (NORMAL, USER) and p]
        normal = self.scores[self.kinds == NORMAL]
        for i in np.flatnonzero(self.kinds == USER).tolist():
            self.scores[i] = len(pieces[i][0].encode()) * normal.max(initial=0.0) - USER_COST
        self.unknown_score = float(normal.min() if len(normal) else 0.0) - PENALTY
        self.unknown_id = next((i for i, (*_, k) in enumerate(pieces) if k == UNKNOWN), 0)
        self.trie = build_trie(usable)
        self.byte_ids = np.full(256, self.unknown_id, np.int64)
        for i, (p, _, k) in enumerate(pieces):
            if k == BYTE:
                self.byte_ids[int(p[3:5], 16)] = i
        self.bytes_of = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k in (CONTROL, UNUSED) else " ⁇ ".encode() if k == UNKNOWN else p.replace(MARK, " ").encode() for p, _, k in pieces]
        #: A marker after another character in a piece would let it pass a segment's end.
        self.whole = any(MARK in p.lstrip(MARK) for p, _, k in pieces if k in (NORMAL, USER))
        self.known: dict[str, bytes] = {}

    # Segments are keyed by their text without the first marker, spaces not yet turned.
    def segments(self, text: str) -> list[str]:
        if not text:
            return []
        if self.whole:
            return [text]
        if "  " in text or text[0] == " " or text[-1] == " ":
            return [m[1:] for m in _RUNS.findall(" " + text)]
        return text.split(" ")

    def encode(self, batch: list[str]) -> list[np.ndarray]:
        if self.settings.squeeze:
            batch = [_SPACES.sub(" ", t).strip(" ") for t in batch]
        if not self.settings.prefix:
            return self._bare(batch)
        return self._marked(batch)

    def _bare(self, batch: list[str]) -> list[np.ndarray]:
        """Without a marker in front: what stands before the first space is solved apart."""
        heads = [t if self.whole else t.partition(" ")[0] for t in batch]
        first = [np.frombuffer(x, "<u4") for x in self.viterbi([h.replace(" ", MARK).encode() for h in heads])] if batch else []
        rest = self._marked([t[len(h) + 1 :] for t, h in zip(batch, heads, strict=True)], [len(h) < len(t) for t, h in zip(batch, heads, strict=True)])
        return [np.concatenate(x) for x in zip(first, rest, strict=True)]

    def _marked(self, batch: list[str], marked: list[bool] | None = None) -> list[np.ndarray]:
        """Texts with a marker in front; an empty text has none, unless it is `marked`."""
        split = [self.segments(t) or [""] * bool(marked and marked[k]) for k, t in enumerate(batch)]
        new: set[str] = set()
        for parts in split:
            new.update(parts)
        if len(self.known) > REMEMBERED:  # what this batch meets again stays
            self.known = {w: self.known[w] for w in new if w in self.known}
        known = self.known
        todo = sorted((w for w in new if w not in known), key=len)
        at = 0
        while at < len(todo):  # blocks of like lengths
            to, size = at, 0
            while to < len(todo) and (to == at or size + len(todo[to]) <= 1 << 17):
                size += len(todo[to])
                to += 1
            known.update(zip(todo[at:to], self.viterbi([(MARK + w.replace(" ", MARK)).encode() for w in todo[at:to]]), strict=True))
            at = to
        return [np.frombuffer(b"".join([known[w] for w in parts]), "<u4") for parts in split]

    def viterbi(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian 32-bit integers."""
        trie, lens = self.trie, np.array([len(w) for w in words], np.int64)
        buf = np.frombuffer(b"".join(words), np.uint8)
        offs = np.concatenate([[0], np.cumsum(lens)])
        stop_of = np.repeat(offs[1:], lens)
        first = (buf & 0xC0) != 0x80
        origin = np.flatnonzero(first)
        edges = []
        # Characters' own lengths: to the next first byte or the word's end.
        width = np.diff(np.append(origin, len(buf)))
        covered = np.zeros(len(origin), bool)
        alive = np.arange(len(origin))
        node, at = np.zeros(len(origin), np.int64), origin.copy()
        while len(alive):
            to = trie.base[node] + buf[at].astype(np.int64) + 1
            good = trie.check[to] == node
            alive, node, at = alive[good], to[good], at[good] + 1
            value = trie.value[node]
            hit = value >= 0
            if hit.any():
                k = alive[hit]
                edges.append((origin[k], at[hit], value[hit]))
                covered[k[at[hit] - origin[k] == width[k]]] = True
            more = at < stop_of[origin[alive]]
            alive, node, at = alive[more], node[more], at[more]
        bare = np.flatnonzero(~covered)
        edges.append((origin[bare], origin[bare] + width[bare], np.full(len(bare), -1)))
        begin, end, piece = (np.concatenate([e[k] for e in edges]).astype(np.int64) for k in range(3))
        score = np.where(piece >= 0, self.scores[piece], self.unknown_score)
        # A node is a byte position; a word's start and the end of the word before it are two.
        word = np.searchsorted(offs, begin, "right") - 1
        begin, end = begin + word, end + word
        depth = end - (offs[:-1] + np.arange(len(words)))[word]
        order = np.lexsort((begin, end, depth))
        begin, end, piece, score, depth = begin[order], end[order], piece[order], score[order], depth[order]
        best = np.full(len(buf) + len(words), -np.inf)
        best[offs[:-1] + np.arange(len(words))] = 0.0
        back = np.full(len(best), -1, np.int64)
        heads = np.flatnonzero(np.concatenate([[True], end[1:] != end[:-1]])) if len(end) else np.zeros(0, np.int64)
        levels = np.flatnonzero(np.concatenate([[True], depth[heads][1:] != depth[heads][:-1]])) if len(heads) else heads
        bounds = [*levels.tolist(), len(heads)]
        heads_end = np.append(heads, len(end))
        for a, b in zip(bounds, bounds[1:], strict=False):
            lo, hi = heads_end[a], heads_end[b]
            sums = best[begin[lo:hi]] + score[lo:hi]
            top = np.maximum.reduceat(sums, heads[a:b] - lo)
            sizes = np.diff(heads_end[a : b + 1])
            is_top = np.flatnonzero(sums == np.repeat(top, sizes))
            group = np.searchsorted(heads[a:b] - lo, is_top, "right") - 1
            chosen = is_top[np.concatenate([[True], group[1:] != group[:-1]])]
            best[end[lo:hi][chosen]] = top
            back[end[lo:hi][chosen]] = chosen + lo
        # Back from the ends, all words at once.
        at = offs[1:] + np.arange(len(words))
        live = np.flatnonzero(lens > 0)
        picked_word, picked_edge = [], []
        home = offs[:-1] + np.arange(len(words))
        while len(live):
            e = back[at[live]]
            picked_word.append(live)
            picked_edge.append(e)
            at[live] = begin[e]
            live = live[at[live] > home[live]]
        if not picked_word:
            return [b""] * len(words)
        rank = np.concatenate([np.full(len(w), -k) for k, w in enumerate(picked_word)])
        words_, edges_ = np.concatenate(picked_word), np.concatenate(picked_edge)
        order = np.lexsort((rank, words_))
        words_, edges_ = words_[order], edges_[order]
        ids = piece[edges_]
        if (ids < 0).any():  # unknown characters become their bytes
            size = np.where(ids < 0, (end - begin)[edges_], 1)
            start = begin[edges_]
            inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            words_, odd, start = np.repeat(words_, size), np.repeat(ids < 0, size), np.repeat(start, size)
            ids = np.where(odd, self.byte_ids[buf[np.where(odd, start - words_ + inner, 0)]], np.repeat(ids, size))
        cut = np.searchsorted(words_, np.arange(len(words) + 1))
        raw = ids.astype("<u4")
        return [raw[a:b].tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: byte pieces joined to UTF-8 (U+FFFD where they are none), markers to spaces, the first dropped."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        return (raw[1:] if raw[:1] == b" " and self.settings.prefix else raw).decode("utf-8", "replace")

    def is_byte(self) -> np.ndarray:
        return self.kinds == BYTE


def load(file: str) -> Unigram:
    return Unigram(*read_model(file))


ENCODED = "doc_id long, ids array<int>"


def encode(docs: DataFrame, file: str) -> DataFrame:
    """(doc_id, text) to (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = per_process(("unigram", file), lambda: load(file))
        for batch in slices(batches):
            yield pa.record_batch([batch.column(0), pa.array([x.astype(np.int32) for x in model.encode(texts(batch.column(1)))], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, file: str) -> DataFrame:
    """(doc_id, ids) to (doc_id, text); null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = per_process(("unigram", file), lambda: load(file))
        for batch in slices(batches):
            yield pa.record_batch([batch.column(0), pa.array([None if x is None else model.decode(np.array(x, np.int64)) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


DIGEST = "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean"


def digest(docs: DataFrame, file: str, with_ids: bool = False) -> DataFrame:
    """Encodes every whole text, decodes the ids and tells what came of it; with_ids: and gives the ids."""
    schema = DIGEST + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = per_process(("unigram", file), lambda: load(file))
        is_byte = model.is_byte()
        for batch in slices(batches):
            rows, given = [], texts(batch.column(1))
            for doc, text, ids in zip(batch.column(0).to_pylist(), given, model.encode(given), strict=True):
                back = model.decode(ids)
                rows.append((doc, len(ids), int(is_byte[ids].sum()), zlib.crc32(ids.tobytes()), hashlib.sha256(back.encode()).hexdigest(), back == text, *[ids.astype(np.int32)] * with_ids))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), *[pa.list_(pa.int32())] * with_ids)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
