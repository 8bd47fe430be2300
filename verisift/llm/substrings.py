"""Removal of repeated passages by difference-cover anchors.

A window is `width` consecutive words of one text.  A word goes if a window that covers it starts anywhere else too.
Anchors are the shorter windows at word positions whose remainder modulo a period v lies in a difference cover
D: for any two positions i and j some k < v puts i + k and j + k both on the cover, so two equal windows share an
aligned anchor of width - v + 1 words.  The work goes in rounds over groups of documents, a few MB of text each:
  1. each group sends its distinct anchors, marked if it has one twice, to buckets by hash; a bucket
     answers each group with those that any other group or a mark repeats;
  2. each group extends: it sends the distinct windows that hold a repeated anchor, and the buckets answer alike;
  3. each group cuts the words that repeated windows cover.
A passage that any number of documents share is one value of each group.  A bucket's size follows the hashes, not
the passages, so no group of copies meets in one task.  A message holds a value at least: there are never more than anchors
and windows, and where groups are few, far fewer.  Rounds compute on the shuffled texts anew and
refer to values, not to rows, so a lost task gives the same answer again.

Anchors only choose windows, by 63-bit hashes; windows count as equal where two independent hashes, 127 bits together, are.  Null texts
have no words.  Windows are judged on the input, so the order of rows does not matter; rows that share a doc_id are texts of their
own (those equal in doc_id and text belong to one group).  A very long text is held whole by its group's task.  An empty
table gives no rows; other columns are ignored, by `remove` carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, partitions
from .kernels import U64, other_window_hashes, utf8, window_hashes, word_bounds, word_hashes

# Perfect difference sets, by their period.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27)}
#: Words of an anchor, at least; with fewer, chance repeats send too many windows.
ANCHOR = 15
#: Bytes of text of a group, and of the texts whose values a bucket gathers, about.
GROUP_BYTES, BUCKET_BYTES = 4 << 20, 8 << 20


def cover_for(width: int) -> tuple[int, tuple[int, ...]]:
    """The longest period that leaves anchors of ANCHOR words, or the shortest that fits."""
    fits = [v for v in COVERS if width - v + 1 >= min(ANCHOR, max(1, width - 2))]
    return (v := max(fits, default=1)), COVERS.get(v, (0,))


class Words:
    """The words of a group's texts, end to end."""

    def __init__(self, table: pa.Table, width: int):
        self.buf, self.offs = utf8(table["text"])
        self.words, self.rows = word_hashes(self.buf, self.offs)
        self.width = width
        n = np.diff(self.rows)
        self.place = np.arange(len(self.words)) - np.repeat(self.rows[:-1], n)
        #: words from here to the text's end, this one included
        self.left = np.repeat(n, n) - self.place

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions on the cover, and a row of one hash for each anchor."""
        period, cover = cover_for(self.width)
        size = self.width - period + 1
        on = np.zeros(period, bool)
        on[list(cover)] = True
        at = np.flatnonzero(on[self.place % period] & (self.left >= size) & (np.repeat(np.diff(self.rows), np.diff(self.rows)) >= self.width))
        return at, (window_hashes(self.words, size)[at] >> U64(1))[:, None]

    def windows(self, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows that hold a repeated anchor, and a row of two hashes for each."""
        at, values = self.anchors()
        period, _ = cover_for(self.width)
        hits = np.zeros(len(self.words) + 1, np.int64)
        hits[at[np.isin(values[:, 0], repeated[:, 0])] + 1] = 1
        total = np.cumsum(hits)
        end = np.minimum(np.arange(len(self.words)) + period, len(self.words))
        start = np.flatnonzero((total[end] > total[:-1]) & (self.left >= self.width))
        return start, np.stack([window_hashes(self.words, self.width)[start] >> U64(1), other_window_hashes(self.words, self.width)[start]], axis=1)

    def removed(self, anchors: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """Which words repeated windows cover."""
        start, values = self.windows(anchors)
        start = start[np.isin(values[:, 0], windows[:, 0]) & np.isin(values[:, 1], windows[:, 1])]
        edge = np.zeros(len(self.words) + self.width + 1, np.int64)
        edge[start] += 1
        edge[start + self.width] -= 1
        return np.cumsum(edge)[: len(self.words)] > 0


_SENT = pa.schema([("bucket", pa.int64()), ("g", pa.int64()), ("sent", pa.binary())])
_ANSWER = pa.schema([("g", pa.int64()), ("answer", pa.binary())])


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that puts equal rows side by side, and where in it each row of a kind begins."""
    order = np.lexsort(values.T[::-1])
    sorted_ = values[order]
    return order, np.flatnonzero(np.concatenate([[True], (sorted_[1:] != sorted_[:-1]).any(1)])) if len(values) else np.zeros(0, np.int64)


def _send(g: int, values: np.ndarray, n_buckets: int) -> pa.Table:
    """A message for each bucket: its distinct rows of hashes, the first hash's lowest bit set for those that the group has twice."""
    order, heads = _runs(values)
    twice = (np.diff(np.append(heads, len(order))) > 1).astype(U64)
    marked = values[order][heads]
    bucket = (marked[:, 0] % U64(n_buckets)).astype(np.int64)
    marked[:, 0] = (marked[:, 0] << U64(1)) | twice
    by_bucket = np.argsort(bucket, kind="stable")
    marked, bucket = marked[by_bucket], bucket[by_bucket]
    ends = np.flatnonzero(np.append(bucket[1:] != bucket[:-1], True)) + 1 if len(bucket) else np.zeros(0, np.int64)
    parts = [marked[a:b].tobytes() for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]
    return pa.table([pa.array(bucket[ends - 1]), pa.array(np.full(len(ends), g)), pa.array(parts, pa.binary())], schema=_SENT)


def _answer(size: int) -> Callable[[pa.Table], pa.Table]:
    """What a bucket tells each group: those of its rows of `size` hashes that stand elsewhere too."""

    def answer(table: pa.Table) -> pa.Table:
        sent = [_rows(x, size) for x in table["sent"].to_pylist()]
        whole = np.concatenate(sent)
        marked = (whole[:, 0] & U64(1)) > 0
        whole[:, 0] >>= U64(1)
        order, heads = _runs(whole)
        counts = np.diff(np.append(heads, len(order)))
        again = (counts > 1) | np.logical_or.reduceat(marked[order], heads)
        mine = np.zeros(len(whole), bool)
        mine[order] = np.repeat(again, counts)
        ends = np.cumsum([len(x) for x in sent])
        found = [(g, whole[b - len(x) : b][mine[b - len(x) : b]].tobytes()) for g, x, b in zip(table["g"].to_pylist(), sent, ends.tolist(), strict=True)]
        found = [x for x in found if x[1]]
        return pa.table([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.binary())], schema=_ANSWER)

    return answer


def _rows(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(data, U64).reshape(-1, size)


def _values(answers: pa.Table, size: int) -> np.ndarray:
    return _rows(b"".join(answers["answer"].to_pylist()), size)


def _run(docs: DataFrame, width: int, finish: Callable[[pa.Table, np.ndarray, Words], pa.Table], schema: str) -> DataFrame:
    """The three rounds over (doc_id, text, ...)."""
    n_bytes, parts = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0], partitions(docs.sparkSession)
    n_groups, n_buckets = max(parts, -(-n_bytes // GROUP_BYTES)), max(-(-parts // 2), -(-n_bytes // BUCKET_BYTES))
    grouped = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_groups)).alias("_g"), "*")

    def first(table: pa.Table) -> pa.Table:
        forget()
        return _send(table["_g"][0].as_py(), Words(table, width).anchors()[1], n_buckets)

    def second(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows or not answers.num_rows:
            return _SENT.empty_table()
        return _send(table["_g"][0].as_py(), Words(table, width).windows(_values(answers, 1))[1], n_buckets)

    def third(table: pa.Table, answers: pa.Table) -> pa.Table:
        words = Words(table, width)
        kinds = np.array(answers["kind"].to_pylist(), np.int64)
        anchors, windows = (_values(answers.filter(pa.array(kinds == k)), k) for k in (1, 2))
        return finish(table, words.removed(anchors, windows) if len(windows) else np.zeros(len(words.words), bool), words)

    sent = "bucket long, g long, sent binary"
    repeated = grouped.groupBy("_g").applyInArrow(first, sent).groupBy("bucket").applyInArrow(_answer(1), "g long, answer binary")
    extended = grouped.groupBy("_g").cogroup(repeated.groupBy("g")).applyInArrow(second, sent).groupBy("bucket").applyInArrow(_answer(2), "g long, answer binary")
    both = repeated.withColumn("kind", F.lit(1)).union(extended.withColumn("kind", F.lit(2)))
    return grouped.groupBy("_g").cogroup(both.groupBy("g")).applyInArrow(third, schema)


DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def digest(docs: DataFrame, width: int = 35) -> DataFrame:
    """(doc_id, text) to word counts and the hash of the words that stay."""

    def finish(table: pa.Table, gone: np.ndarray, words: Words) -> pa.Table:
        raw, offs, rows = words.buf.tobytes(), words.offs.tolist(), words.rows.tolist()
        before = np.concatenate([[0], np.cumsum(gone)])
        n_gone = before[words.rows[1:]] - before[words.rows[:-1]]
        shas = []
        for k, cut in enumerate(n_gone.tolist()):
            own = raw[offs[k] : offs[k + 1]].split()
            if cut:
                own = compress(own, (~gone[rows[k] : rows[k + 1]]).tolist())
            shas.append(hashlib.sha256(b" ".join(own)).hexdigest())
        return pa.table([table["doc_id"], pa.array(np.diff(words.rows)), pa.array(n_gone), pa.array(shas)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _run(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), width, finish, DIGEST)


def remove(docs: DataFrame, width: int = 35) -> DataFrame:
    """All columns, `text` without its repeated words (each goes with the white space after it), and n_removed."""
    docs = docs.drop("n_removed")
    names = docs.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "n_removed bigint"])

    def finish(table: pa.Table, gone: np.ndarray, words: Words) -> pa.Table:
        texts, counts = table["text"].to_pylist(), []
        for k in range(len(texts)):
            own = gone[words.rows[k] : words.rows[k + 1]]
            counts.append(int(own.sum()))
            if counts[-1]:
                raw = words.buf[words.offs[k] : words.offs[k + 1]]
                starts, _, _ = word_bounds(raw, np.array([0, len(raw)]))
                stays = np.repeat(np.concatenate([[True], ~own]), np.diff(np.concatenate([[0], starts, [len(raw)]])))
                texts[k] = raw[stays].tobytes().decode()
        columns = [pa.array(texts, pa.string()) if n == "text" else table[n] for n in names]
        return pa.table([*columns, pa.array(counts, pa.int64())], [*names, "n_removed"])

    return _run(docs, width, finish, schema)
