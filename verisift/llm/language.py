"""Language identification of multilingual texts by mixture inference.

A language's model gives each word the product of its character n-grams' smoothed
likelihoods (the word between two boundary marks).  A document is a mixture: every word comes from one
language of a set, with proportions that expectation-maximisation estimates.  The set is chosen by
penalised likelihood: from all languages, the one of smallest proportion is dropped as long as
2 * log likelihood falls by less than PENALTY * ln(words) (the price of one proportion).  Each document's estimation ends by its own
change, however many rounds that takes, so a prediction is a function of the text and the model alone.

Models are fitted on a bounded sample of labelled rows: of each of at most `fit_languages` languages (those of most rows) at most `fit_rows`
rows, those of smallest hash of their id, and of each row's text at most `fit_chars` characters.  Prediction reads whole texts, whatever
their length, and nothing but the text.  With no labelled row at all every row is `und`.

`und` with score 0 is given for null texts and for those without a letter.  Ties between proportions go to
the language that sorts first.  Rows that share a doc_id are kept apart; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import per_process, slices

#: Characters of an n-gram, labelled rows per language, weight of an unseen n-gram.
ORDER, FIT_ROWS, SMOOTHING = 3, 1000, 0.5
#: Languages that are learnt at most, and characters of each labelled text.
FIT_LANGUAGES, FIT_CHARS = 200, 10_000
#: Price of one more language, for each unit of ln(words).
PENALTY = 4.0
#: The change of a document's proportions that ends its expectation-maximisation.
ENOUGH = 1e-3
UNDETERMINED = "und"
#: Words that a worker remembers.
REMEMBERED = 150_000
#: Letters: word characters that are no digit or underscore.
_WORD = re.compile(r"[^\W\d_]+")


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the n-grams of all words, each between two marks, and each word's number of them."""
    points = np.frombuffer("".join([f"\x02{w}\x03" for w in words]).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) for w in words], np.int64) + 2 - (ORDER - 1)
    keys = points[: len(points) - ORDER + 1].copy()
    for k in range(1, ORDER):
        keys = keys << np.uint64(21) | points[k : len(points) - ORDER + 1 + k]
    inside = np.ones(len(points), bool)  # starts whose n-gram does not pass the word's end
    ends = np.cumsum(sizes + ORDER - 1)
    for k in range(1, ORDER):
        inside[ends - k] = False
    return keys[inside[: len(keys)]], sizes


@dataclass
class Model:
    languages: list[str]
    #: Keys of n-grams, ascending; log likelihoods, a row for each and a last one for an n-gram not seen.
    keys: np.ndarray
    logs: np.ndarray


def fit(rows: list[tuple[str, str]]) -> Model:
    """A model of (language, text) rows."""
    words: dict[str, Counter] = {}
    for lang, text in rows:
        words.setdefault(lang, Counter()).update(_WORD.findall(text.lower()))
    languages = sorted(words)
    found = []
    for lang in languages:
        keys, sizes = grams(list(words[lang]))
        found.append((keys, np.repeat(np.array(list(words[lang].values()), np.float64), sizes)))
    vocabulary = np.unique(np.concatenate([k for k, _ in found])) if found else np.zeros(0, np.uint64)
    counts = np.stack([np.bincount(np.searchsorted(vocabulary, k), n, len(vocabulary) + 1) for k, n in found], axis=1) if found else np.zeros((1, 0))
    counts += SMOOTHING
    return Model(languages, vocabulary, np.log(counts / counts.sum(0)))


class Detector:
    """Predicts documents with one model; remembers words' log likelihoods."""

    def __init__(self, model: Model):
        self.model = model
        self.rows: dict[str, int] = {}
        self.logs = np.zeros((len(model.languages), 1024), np.float32)

    def _learn(self, words: list[str]) -> None:
        width, room = self.logs.shape
        if len(self.rows) + len(words) > room:
            self.logs = np.concatenate([self.logs, np.zeros((width, max(room, len(words))), np.float32)], axis=1)
        keys, sizes = grams(words)
        vocabulary = self.model.keys
        place = np.minimum(np.searchsorted(vocabulary, keys), max(len(vocabulary) - 1, 0))
        place[vocabulary[place] != keys] = len(vocabulary)
        logs = np.add.reduceat(self.model.logs[place], np.cumsum(sizes) - sizes, axis=0)
        at = len(self.rows)
        self.logs[:, at : at + len(words)] = logs.T
        self.rows.update(zip(words, range(at, at + len(words)), strict=True))

    def __call__(self, batch: list[str | None]) -> list[tuple[str, float, dict[str, float]]]:
        """Language, its proportion, and the proportions of the chosen set, for each text."""
        if not self.model.languages:
            return [(UNDETERMINED, 0.0, {})] * len(batch)
        split = [_WORD.findall(t.lower()) if t else [] for t in batch]
        new: set[str] = set()
        for parts in split:
            new.update(parts)
        if len(self.rows) > REMEMBERED:  # what this batch meets again stays
            kept = [w for w in new if w in self.rows]
            self.logs = self.logs[:, [self.rows[w] for w in kept]]
            self.rows = {w: k for k, w in enumerate(kept)}
        todo = [w for w in new if w not in self.rows]
        for at in range(0, len(todo), 1 << 14):
            self._learn(todo[at : at + (1 << 14)])
        out: list[tuple[str, float, dict[str, float]]] = [(UNDETERMINED, 0.0, {})] * len(batch)
        live = [k for k, parts in enumerate(split) if parts]
        languages = self.model.languages
        for at in range(0, len(live), 256):
            some = live[at : at + 256]
            rows = self.rows
            logs = self.logs[:, np.array([rows[w] for k in some for w in split[k]])]
            shares = infer(logs, np.array([len(split[k]) for k in some]))
            for k, own in zip(some, shares, strict=True):
                best = int(own.argmax())
                out[k] = (languages[best], min(1.0, float(own[best])), {languages[j]: float(x) for j, x in enumerate(own) if x > 0})
        return out


def infer(logs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Proportions of each document over the languages of its chosen set; logs: a row for each language, the words document by document."""
    width, n = len(logs), len(sizes)
    likely = np.exp(np.maximum(logs - logs.max(0), -60.0)).astype(np.float32)
    allowed = np.ones((width, n), bool)
    shares, fits = em(likely, sizes, allowed)
    price = PENALTY * np.log(np.maximum(sizes, 2))
    starts, open_ = np.cumsum(sizes) - sizes, np.arange(n)
    for _ in range(width - 1):  # drop one language at a time, in the documents where that pays
        weakest = np.where(allowed[:, open_], shares[:, open_], np.inf).argmin(0)
        fewer = allowed[:, open_].copy()
        fewer[weakest, np.arange(len(open_))] = False
        own = sizes[open_]
        take = slice(None) if len(open_) == n else np.repeat(starts[open_] - (np.cumsum(own) - own), own) + np.arange(own.sum())
        new_shares, new_fits = em(likely[:, take], own, fewer)
        pays = 2 * (fits[open_] - new_fits) < price[open_]
        good = open_[pays]
        allowed[:, good], shares[:, good], fits[good] = fewer[:, pays], new_shares[:, pays], new_fits[pays]
        open_ = good
        if not len(open_):
            break
    return shares.T


def em(likely: np.ndarray, sizes: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log likelihoods (less the words' own top) of mixtures of the allowed languages."""
    shares = allowed / allowed.sum(0)

    def mixed(part: np.ndarray, n: np.ndarray, own: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        parts = [row * np.repeat(share.astype(np.float32), n) for row, share in zip(part, own, strict=True)]
        return parts, np.maximum(sum(parts[1:], parts[0]), np.float32(1e-37))

    live, part = np.flatnonzero(allowed.sum(0) > 1), likely
    if len(live) < len(sizes):
        part = likely[:, np.repeat(np.isin(np.arange(len(sizes)), live), sizes)]
    while len(live):  # the proportions' change goes to 0, as the likelihood is bounded
        n = sizes[live]
        starts = np.cumsum(n) - n
        parts, total = mixed(part, n, shares[:, live])
        new = np.stack([np.add.reduceat((p / total).astype(np.float64), starts) for p in parts]) / n
        new /= new.sum(0)
        moves = np.abs(new - shares[:, live]).max(0) >= ENOUGH
        shares[:, live] = new
        if not moves.all():
            part, live = part[:, np.repeat(moves, n)], live[moves]
    return shares, np.add.reduceat(np.log(mixed(likely, sizes, shares)[1]).astype(np.float64), np.cumsum(sizes) - sizes)


def training_rows(docs: DataFrame, usable, fit_rows: int = FIT_ROWS, fit_languages: int = FIT_LANGUAGES, fit_chars: int = FIT_CHARS) -> list[tuple[str, str]]:
    """(language, start of a text): the bounded sample of the rows for which `usable` holds."""
    labelled = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("doc_id").alias("id"), F.substring("text", 1, fit_chars).alias("text"), F.sha2(F.concat_ws(":", F.lit("fit"), F.col("doc_id").cast("string")), 256).alias("key"))
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(fit_languages).collect()}
    if not sizes:
        return []
    # A cut at a quantile of the hash keeps what is ranked small; the rank then cuts exactly.
    share = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(min(1.0, 4 * fit_rows / n))) for lang, n in sorted(sizes.items())], F.lit(0.0))
    near = labelled.where(F.conv(F.substring("key", 1, 13), 16, 10).cast("double") / float(1 << 52) < share)
    chosen = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("key", "id", F.xxhash64("text")))).where(F.col("rank") <= fit_rows)
    return sorted((r.lang, r.text) for r in chosen.select("lang", "text").collect())


PREDICTED = "lang_pred string, score double, n_languages int, proportions map<string,double>"


def detect(docs: DataFrame, model: Model, carry: list[str]) -> DataFrame:
    """The columns `carry` and the prediction of each row's text."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema), PREDICTED])
    names = [*carry, "lang_pred", "score", "n_languages", "proportions"]
    key = ("language", tuple(model.languages), len(model.keys), float(model.logs.sum()))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded as the sample is

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = per_process(key, lambda: Detector(shared.value))
        for batch in slices(batches):
            found = detector(batch.column(len(carry)).to_pylist())
            columns = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([len(x[2]) for x in found], pa.int32()), pa.array([list(x[2].items()) for x in found], pa.map_(pa.string(), pa.float64()))]
            yield pa.record_batch([*(batch.column(k) for k in range(len(carry))), *columns], names)

    return docs.select(*carry, F.col("text").alias("_text")).mapInArrow(run, schema)
