"""Content-addressed store of token ids.

Every text becomes a stream of ids.  A rolling hash over the last WINDOW ids cuts
the stream wherever its low bits are zero (no chunk under MIN or over MAX ids, but
a document's last), so that equal passages give equal chunks wherever they stand.
A chunk is named by the BLAKE2b hash of its ids and stored once (`chunks`); a document's
recipe (`recipes`, in ascending doc_id order) lists the names and sizes of its chunks and
ends in their Merkle root.  Reading back hashes every stored chunk anew and holds
recipes, sizes and roots against what is found.

Files, below one folder:
  chunks   name binary(16), n int, body binary: zstd of the ids as little-endian
           16-bit integers, or 32-bit ones after a first byte of 4 (else 2)
  recipes  rid long (ascending with doc_id), doc_id, n_tokens long,
           recipe binary: 16 bytes of name and 4 bytes of size (big-endian) for each chunk,
           root binary(16)

  manifest part, n_docs, root: the Merkle root over the documents' roots of each recipe file, in order

Null texts count as empty: such a document holds the end id alone.  Rows that share a
doc_id (or have none: they come first) are documents of their own, in any order, and dealt among tasks.  A very long text is one
stream, held whole by the task that encodes it and by the one that joins its chunks.  An empty table gives empty files and
no rows.  Other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_at_end, drop_dir, partitions, per_process, shared_dir, slices
from .kernels import U64, mix, window_hashes

WINDOW, MIN, AVERAGE, MAX = 16, 256, 1024, 8192
#: Words whose ids a Python worker remembers, and bytes of text that it encodes at once.
REMEMBERED, BATCH_BYTES = 500_000, 8 << 20
#: White characters, and a space between two of them or between one and the text's end; there a split at spaces would not be the tokenizer's own.
_SPACE = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"
_INNER = rf"{_SPACE} (?:{_SPACE}|\z)"


class Ragged:
    """Rows of ids, end to end."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        self.flat, self.sizes = flat, sizes
        self.begins = np.cumsum(sizes) - sizes

    def rows(self, which: np.ndarray) -> "Ragged":
        sizes = self.sizes[which]
        return Ragged(self.flat[np.repeat(self.begins[which] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())], sizes)

    def __add__(self, more: "Ragged") -> "Ragged":
        return Ragged(np.concatenate([self.flat, more.flat]), np.concatenate([self.sizes, more.sizes]))


class WordEncoder:
    """Ids of whole texts by the tokenizers library.

    A byte-level pre-tokenizer parts a text before every space that follows or precedes a non-white character, and encodes
    the parts alone.  So words, each with the space before it, can be encoded in any company: those of a batch that were not
    met before go to the library in one call, and are parted again where an id begins with the space.  Texts with other white space
    between spaces, and those that hold an added token, go to the library whole.
    """

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        vocabulary = self.tokenizer.get_vocab()
        space = next(t for t, i in vocabulary.items() if t and self.tokenizer.decode([i]) == " ")
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for t, i in vocabulary.items() if t.startswith(space)]] = True
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Words and, row by row, their ids after a space.
        self.words, self.ids = pa.array([], pa.string()), Ragged(np.zeros(0, "<u4"), np.zeros(0, np.int64))

    def _each(self, texts: list[str]) -> Ragged:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return Ragged(np.fromiter(chain.from_iterable(ids), "<u4"), np.array([len(own) for own in ids], np.int64))

    def _after_space(self, words: pa.Array) -> Ragged:
        """Ids of each word with a space before it."""
        out = [Ragged(np.zeros(0, "<u4"), np.zeros(0, np.int64))]
        for at in range(0, len(words), 1 << 16):
            some = words.slice(at, 1 << 16).to_pylist()
            ids = self._each([" " + " ".join(some[k : k + 64]) for k in range(0, len(some), 64)]).flat
            starts = np.flatnonzero(self.begins[ids])
            # As many starts as words, unless an id holds a space alone, or two.
            out.append(Ragged(ids, np.diff(np.append(starts, len(ids)))) if len(starts) == len(some) and "" not in some else self._each([f" {w}" for w in some]))
        return Ragged(np.concatenate([x.flat for x in out]), np.concatenate([x.sizes for x in out]))

    def __call__(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, end to end, each with the end id, and the n + 1 offsets into them."""
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(1, np.int64)
        texts = pc.fill_null(texts, "")
        whole = functools.reduce(pc.or_, [pc.match_substring_regex(texts, _INNER), *[pc.match_substring(texts, t) for t in self.added]])
        whole = whole.to_numpy(zero_copy_only=False)
        split = pc.split_pattern(texts, " ")
        rows = split.offsets.to_numpy().astype(np.int64)
        parts = split.values.slice(rows[0], rows[-1] - rows[0])
        rows -= rows[0]
        inner = np.ones(len(parts), bool)  # words after a space, of texts that are parted
        inner[rows[:-1]] = False
        inner &= ~np.repeat(whole, np.diff(rows))
        place = pc.index_in(parts, value_set=self.words)
        new = parts.filter(pc.and_(pc.is_null(place), pa.array(inner))).dictionary_encode().dictionary
        self.words, self.ids = pa.concat_arrays([self.words, new]), self.ids + self._after_space(new)
        if len(new):
            place = pc.coalesce(place, pc.add(pc.index_in(parts, value_set=new), len(self.words) - len(new)))
        codes = pc.fill_null(place, 0).to_numpy().astype(np.int64)
        # Behind the words' ids stand those of the first words and of texts that go whole; a last row is empty.
        firsts = parts.take(pa.array(rows[:-1])).to_pylist()
        for k in np.flatnonzero(whole).tolist():
            firsts[k] = texts[k].as_py()
        some = self.ids + self._each(firsts) + Ragged(np.zeros(0, "<u4"), np.zeros(1, np.int64))
        codes[~inner] = len(some.sizes) - 1
        codes[rows[:-1]] = len(self.words) + np.arange(len(texts))
        found = some.rows(codes)
        if len(self.words) > REMEMBERED:  # what this batch used stays
            used = np.flatnonzero(np.bincount(codes[inner], minlength=1))
            self.words, self.ids = self.words.take(pa.array(used)), self.ids.rows(used)
        ends = np.cumsum(found.sizes)[rows[1:] - 1]
        return np.insert(found.flat, ends, np.uint32(end)), np.concatenate([[0], ends + np.arange(1, len(texts) + 1)])


def marks(ids: np.ndarray) -> np.ndarray:
    """Where the last WINDOW ids ask for a cut."""
    hashes = window_hashes(mix(ids.astype(U64)), WINDOW)
    return np.flatnonzero(hashes & U64(AVERAGE - 1) == 0) + WINDOW


def cuts(n: int, asked: list[int]) -> list[int]:
    """Ends of the chunks of a stream of n ids that asks for cuts there; those with fewer than MIN ids before them do not count, so a window never reaches over the stream's start."""
    out, at = [], 0
    if n > MIN:
        for mark in [*asked, n]:
            while mark - at > MAX:
                at += MAX
                out.append(at)
            if mark - at >= MIN and mark < n:
                at = mark
                out.append(at)
    return [*out, n] if at < n else out


@functools.cache
def _compressor() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=1)


def pack(ids: np.ndarray) -> bytes:
    small = not len(ids) or ids.max() < 1 << 16
    return bytes([2 if small else 4]) + _compressor().compress(ids.astype("<u2" if small else "<u4").tobytes())


def unpack(body: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(body[1:]), f"<u{body[0]}").astype("<u4")


def name_of(ids: np.ndarray) -> bytes:
    return hashlib.blake2b(ids.astype("<u4").tobytes(), digest_size=16).digest()


def _leaf(value: bytes) -> bytes:
    return hashlib.blake2b(b"\0" + value, digest_size=16).digest()


def _node(left: bytes, right: bytes) -> bytes:
    return hashlib.blake2b(b"\1" + left + right, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd node goes up as it is."""
    level = [_leaf(x) for x in leaves]
    while len(level) > 1:
        level = [_node(level[k], level[k + 1]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0] if level else bytes(16)


_STAGED = "doc_id long, n_tokens long, recipe binary, root binary, name binary, n int, body binary"


def _stage(file: str, end_id: int):
    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = per_process(("word-encoder", file), lambda: WordEncoder(file)), set()
        for batch in slices(batches, BATCH_BYTES):
            docs, chunks = [], []
            whole, offs = encoder(batch.column(1), end_id)
            raw = whole.tobytes()
            asked = marks(whole)
            places, starts = np.searchsorted(asked, offs).tolist(), offs.tolist()
            for k, doc in enumerate(batch.column(0).to_pylist()):
                at, n = starts[k], starts[k + 1] - starts[k]
                recipe, leaves, last = [], [], 0
                for to in cuts(n, (asked[places[k] : places[k + 1]] - at).tolist()):
                    leaves.append(name := hashlib.blake2b(raw[4 * (at + last) : 4 * (at + to)], digest_size=16).digest())
                    recipe.append(name + (to - last).to_bytes(4, "big"))
                    if name not in seen:
                        seen.add(name)
                        chunks.append((None, None, None, None, name, to - last, pack(whole[at + last : at + to])))
                    last = to
                docs.append((doc, n, b"".join(recipe), merkle(leaves), None, None, None))
            if len(seen) > REMEMBERED:
                seen = set()
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary())
            columns = list(zip(*docs, *chunks, strict=True)) if docs else [()] * 7
            out = pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in _STAGED.split(", ")])
            del docs, chunks, columns, whole, raw
            pa.default_memory_pool().release_unused()
            yield out

    return stage


def write_store(docs: DataFrame, at: str, tokenizer: str, end_id: int) -> None:
    """Writes chunks and recipes of (doc_id, text) below the folder `at`."""
    spark = docs.sparkSession
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_stage(tokenizer, end_id), _STAGED).write.option("compression", "none").parquet(f"{at}/staged")
    staged = spark.read.schema(_STAGED).parquet(f"{at}/staged")
    staged.where("name is not null").select("name", "n", "body").dropDuplicates(["name"]).write.option("compression", "none").parquet(f"{at}/chunks")
    # The place in the staged files parts rows of one id (or of none) among tasks.
    recipes = staged.where("recipe is not null").select("doc_id", "n_tokens", "recipe", "root").withColumn("place", F.monotonically_increasing_id())
    ordered = recipes.repartitionByRange(partitions(spark), "doc_id", "place").sortWithinPartitions("doc_id", "place").drop("place")
    ordered.select(F.monotonically_increasing_id().alias("rid"), "*").write.parquet(f"{at}/recipes")
    manifest(spark, at).write.parquet(f"{at}/manifest")
    drop_dir(spark, f"{at}/staged")


def _recipes(spark: SparkSession, at: str) -> DataFrame:
    return spark.read.schema("rid long, doc_id long, n_tokens long, recipe binary, root binary").parquet(f"{at}/recipes").withColumn("part", F.shiftright("rid", 33))


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The Merkle root over the documents' roots of each task's part, in order; a part is read by one task, in order of rid."""
    part, tree, n = None, [], 0

    def row() -> pa.RecordBatch:
        root = functools.reduce(lambda right, left: _node(left, right), [x for _, x in reversed(tree)])
        return pa.record_batch([pa.array([part], pa.int64()), pa.array([n], pa.int64()), pa.array([root], pa.binary())], ["part", "n_docs", "root"])

    for batch in batches:
        for own, root in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if own != part and tree:
                yield row()
                tree, n = [], 0
            part, node, n = own, (1, _leaf(root)), n + 1
            while tree and tree[-1][0] == node[0]:  # a full pair goes up: no more nodes are held than the tree has levels
                node = (node[0] * 2, _node(tree.pop()[1], node[1]))
            tree.append(node)
    if tree:
        yield row()


def manifest(spark: SparkSession, at: str) -> DataFrame:
    """(part, n_docs, root): the Merkle root over the documents' roots of each recipe file, in order."""
    ordered = _recipes(spark, at).repartitionByRange(partitions(spark), "part").sortWithinPartitions("part", "rid")
    return ordered.select("part", "root").mapInArrow(_roots, "part long, n_docs long, root binary")


def manifest_root(spark: SparkSession, at: str) -> bytes:
    """The root over the whole store: of the recipe files' roots, a row for each file."""
    return merkle([bytes(r.root) for r in spark.read.schema("part long, n_docs long, root binary").parquet(f"{at}/manifest").orderBy("part").collect()])


def store_is_whole(spark: SparkSession, at: str) -> bool:
    """Whether the recipes still give the manifest that was written with them."""
    written = spark.read.schema("part long, n_docs long, root binary").parquet(f"{at}/manifest")
    return written.exceptAll(manifest(spark, at)).isEmpty() and manifest(spark, at).exceptAll(written).isEmpty()


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = []
        for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = unpack(body)
            rows.append((name, len(ids), zlib.crc32(ids.tobytes()), name_of(ids) == name))
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 4, (pa.binary(), pa.int32(), pa.int64(), pa.bool_()), strict=True)], ["name", "found_n", "crc", "ok"])


#: The CRC-32 polynomial, lowest power in the highest bit.
CRC_POLYNOMIAL = 0xEDB88320


def _times(a: int, b: int) -> int:
    """The product of two polynomials modulo the CRC polynomial."""
    out = 0
    while a:
        if a & 0x80000000:
            out ^= b
        a = a << 1 & 0xFFFFFFFF
        b = b >> 1 ^ (CRC_POLYNOMIAL if b & 1 else 0)
    return out


_SHIFTS: dict[int, int] = {}


def _shift(n_bytes: int) -> int:
    """x to the power 8 * n_bytes."""
    if n_bytes not in _SHIFTS:
        out, power, left = 0x80000000, 0x00800000, n_bytes
        while left:
            if left & 1:
                out = _times(out, power)
            power, left = _times(power, power), left >> 1
        _SHIFTS[n_bytes] = out
    return _SHIFTS[n_bytes]


def joined_crc(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of a concatenation from each part's own and its length in bytes."""
    out = 0
    for crc, n in parts:
        out = _times(_shift(n), out) ^ crc if out else crc
    return out


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        chunks, rows = batch.column(4), []
        offs, each = chunks.offsets.to_pylist(), chunks.values
        k, name, n, found, crc, ok = (each.field(i).to_pylist() for i in range(6))
        for doc, start, size, root, a, b in zip(*(c.to_pylist() for c in batch.columns[:4]), offs, offs[1:], strict=False):
            order = sorted(range(a, b), key=k.__getitem__)
            good = sum(n[a:b]) == size and all(ok[a:b]) and n[a:b] == found[a:b] and merkle([name[i] for i in order]) == root
            rows.append((doc, start, sum(x or 0 for x in found[a:b]), joined_crc([(crc[i] or 0, 4 * (found[i] or 0)) for i in order]), b - a, root.hex(), good))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_())
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 7, kinds, strict=True)], [x.split()[0] for x in _REBUILT.split(", ")])


_REBUILT = "doc_id long, start long, n_tokens long, ids_crc32 long, n_chunks int, merkle_root string, verified boolean"


def _listed(recipes: DataFrame) -> DataFrame:
    """A row for each chunk of each recipe: place k, name and size n."""
    others = [c for c in recipes.columns if c != "recipe"]
    each = recipes.select("*", F.explode(F.sequence(F.lit(0), (F.length("recipe") / 20 - 1).cast("int"))).alias("k"))
    return each.select(*others, "k", F.expr("substring(recipe, k * 20 + 1, 16)").alias("name"), F.conv(F.hex(F.expr("substring(recipe, k * 20 + 17, 4)")), 16, 10).cast("int").alias("n"))


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        docs, ids, good = batch.column(0), [], []
        for root, chunks in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            chunks = sorted(chunks, key=lambda c: c["k"])
            parts = [unpack(c["body"]) if c["body"] else np.zeros(0, "<u4") for c in chunks]
            ids.append(np.concatenate(parts).astype(np.int32))
            good.append(merkle([name_of(p) for p in parts]) == root)
        yield pa.record_batch([docs, pa.array(ids, pa.list_(pa.int32())), pa.array(good, pa.bool_())], ["doc_id", "ids", "verified"])


def read_ids(spark: SparkSession, at: str) -> DataFrame:
    """(doc_id, ids, verified): every document's ids, its end id too, joined from the stored chunks; false where they do not give its root."""
    chunks = spark.read.schema("name binary, n int, body binary").parquet(f"{at}/chunks").select("name", "body")
    whole = _listed(_recipes(spark, at).select("rid", "doc_id", "root", "recipe")).join(chunks, "name", "left").groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.first("root").alias("root"), F.collect_list(F.struct("k", "body")).alias("chunks"))
    return whole.select("doc_id", "root", "chunks").mapInArrow(_streams, "doc_id long, ids array<int>, verified boolean")


def read_store(spark: SparkSession, at: str) -> DataFrame:
    """One row per document from the files alone; `verified` is false where a chunk is missing or altered.

    The sums before each recipe file (one row per file) are all that meets in one place.
    """
    recipes = _recipes(spark, at)
    found = spark.read.schema("name binary, n int, body binary").parquet(f"{at}/chunks").select("name", "body").mapInArrow(_found, "name binary, found_n int, crc long, ok boolean")
    sums = recipes.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).select("part", "before")
    in_part = Window.partitionBy("part").orderBy("rid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = recipes.withColumn("inner", F.sum("n_tokens").over(in_part) - F.col("n_tokens")).join(sums, "part").withColumn("start", F.col("before") + F.col("inner"))
    listed = _listed(starts.select("rid", "doc_id", "start", "n_tokens", "root", "recipe"))
    whole = listed.join(found, "name", "left").groupBy("rid").agg(
        F.first("doc_id").alias("doc_id"), F.first("start").alias("start"), F.first("n_tokens").alias("n_tokens"), F.first("root").alias("root"),
        F.collect_list(F.struct("k", "name", "n", "found_n", "crc", F.coalesce("ok", F.lit(False)).alias("ok"))).alias("chunks"),
    )
    return whole.select("doc_id", "start", "n_tokens", "root", "chunks").mapInArrow(_rebuild, _REBUILT)


def token_store(docs: DataFrame, tokenizer: str, end_id: int = 0, at: str | None = None) -> DataFrame:
    """Writes the store and reads it back; without a place of its own it goes when the driver ends."""
    if not at:
        at = shared_dir(docs.sparkSession, "token-store")
        drop_at_end(docs.sparkSession, at)
    write_store(docs, at, tokenizer, end_id)
    return read_store(docs.sparkSession, at)
