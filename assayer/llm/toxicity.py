"""Toxicity: averaged subword-bag embeddings under a linear softmax, trained jointly in numpy.

A word is the set of its character n-grams (with word-edge marks) and itself; every subword owns one row of a hashed
embedding table, a word's vector is the mean of its subwords' rows, a document's vector is the mean over its words, and a
softmax layer maps that vector to the two classes. Table and layer are trained together by Adagrad. A misspelt insult that
training never saw still shares most of its n-grams with the insult.

Scoring needs only the table's projection on the difference of the two class weights: one float for each subword, a
broadcast of fixed size. Words repeat, so each Python worker keeps the values of words it has met in a bounded cache; those that
it lacks are hashed by columns, all words of some texts at once.

Defined results: a null or empty text scores the class prior. Repeated rows score alike; a null id keeps its row; a table
without rows gives none; other columns pass through untouched. If one class is missing among the labels, the prior decides.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, documents, every, forget, fresh, sliced

WORD = re.compile(r"\w+")
CACHE_WORDS = 64_000
CACHED_LENGTH = 40
#: Bytes of words whose n-grams are hashed at once.
HASHED_BYTES = 1 << 16
#: Characters of texts whose words are looked up at once; a longer text comes alone.
SCORED_CHARS = 1 << 17


@dataclass(frozen=True)
class Settings:
    """sample and sample_chars: labelled rows, and characters of them, that training reads at most, in the order of a hash of
    their id (a row that would pass sample_chars is left out, the next ones may fit); the other fields shape the model."""

    sample: int = 8000
    sample_chars: int = 48_000_000
    buckets: int = 1 << 16
    dim: int = 6
    ngrams: tuple[int, ...] = (3, 4, 5)
    epochs: int = 9
    batch: int = 128
    rate: float = 0.25
    gain: float = 60.0
    decay: float = 1e-6
    seed: int = 17


def subwords(word: str, settings: Settings) -> list[int]:
    """Rows of the table for a word: itself and its n-grams between edge marks."""
    marked = f"<{word}>".encode()
    size = len(marked)
    mask = settings.buckets - 1
    return [zlib.crc32(marked) & mask] + [zlib.crc32(marked[i : i + n]) & mask for n in settings.ngrams for i in range(size - n + 1)]


@lru_cache
def effects(n: int) -> np.ndarray:
    """What each byte value adds, by exclusive or, to the CRC-32 of any string that ends n bytes after it."""
    return np.array([zlib.crc32(bytes([b]) + bytes(n)) ^ zlib.crc32(bytes(n + 1)) for b in range(256)], np.uint32)


def gram_sums(marked: list[bytes], settings: Settings, table: np.ndarray) -> np.ndarray:
    """For each marked word, the sum of the table's values over its n-grams: the rows of `subwords` but the first. CRC-32 is
    linear, so the hash of the n bytes from a place on is that of the n - 1 bytes after it and the effect of one byte more.
    A word's values are added one after the other, so its sum is the same to the last bit wherever the word lies."""
    raw = np.frombuffer(b"".join(marked), np.uint8)
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    ends = np.cumsum(lengths)
    sums, longest = np.zeros(len(marked)), max(settings.ngrams, default=1)
    for at in range(0, len(raw), HASHED_BYTES):
        stop = min(at + HASHED_BYTES, len(raw))
        first, last = np.searchsorted(ends, (at, stop - 1), "right")
        end = ends[first : last + 1]
        inside = np.minimum(end, stop) - np.maximum(end - lengths[first : last + 1], at)
        left = np.repeat(end, inside) - np.arange(at, stop)
        part = raw[at : stop + longest - 1]
        values, hashed = np.zeros(stop - at), np.zeros(len(part) + 1, np.uint32)
        for n in range(1, longest + 1):
            hashed = effects(n - 1)[part[: max(0, len(part) - n + 1)]] ^ hashed[1:]
            if n in settings.ngrams:
                rows = (hashed[: stop - at] ^ np.uint32(zlib.crc32(bytes(n)))) & np.uint32(settings.buckets - 1)
                values[: len(rows)] += np.where(left[: len(rows)] >= n, table[rows], 0)
        values[0] += sums[first]
        sums[first : last + 1] = np.bincount(np.repeat(np.arange(len(end)), inside), values, len(end))
    return sums


@dataclass
class Model:
    """table: a float for each subword, the projection of its embedding on the difference of the class weights."""

    table: np.ndarray
    bias: float
    settings: Settings = field(default_factory=Settings)
    words: dict[str, float] = field(default_factory=dict)

    def __getstate__(self):
        return {"table": self.table, "bias": self.bias, "settings": self.settings, "words": {}}

    def learn(self, words: Iterable[str]) -> dict[str, float]:
        """Values of words that the cache lacks."""
        new = list(words)
        marked = [f"<{w}>".encode() for w in new]
        whole = self.table[np.fromiter(map(zlib.crc32, marked), np.int64, len(new)) & (self.settings.buckets - 1)]
        lengths = np.fromiter(map(len, marked), np.int64, len(new))
        counts = 1 + sum(np.maximum(lengths - n + 1, 0) for n in self.settings.ngrams)
        return dict(zip(new, ((whole + gram_sums(marked, self.settings, self.table)) / counts).tolist(), strict=True))

    def means(self, found: list[list[str]]) -> list[float]:
        """Mean value of the words of each text; what the cache lacks is learned for all of them at once."""
        known, own = self.words, set().union(*found)
        missing = own.difference(known)
        if missing and len(known) + len(missing) > CACHE_WORDS:
            known.clear()
            missing = own
        if missing:
            known.update(self.learn(missing))
        out = [sum(map(known.__getitem__, words)) / len(words) if words else 0.0 for words in found]
        for w in missing:
            if len(w) > CACHED_LENGTH:
                del known[w]
        if len(known) > CACHE_WORDS:
            known.clear()
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        """Probability of the toxic class for each text."""
        means, found, chars = [], [], 0
        for text in texts:
            found.append(WORD.findall(text.lower()))
            chars += len(text)
            if chars >= SCORED_CHARS:
                means += self.means(found)
                found, chars = [], 0
        means += self.means(found)
        out = self.settings.gain * np.array(means) + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(out, -60, 60)))


def train(rows: Iterable[tuple[str, int]], settings: Settings) -> Model:
    """Fit table and softmax layer together on (text, label) rows, settings.sample at most; no text is kept longer than its row."""
    index: dict[str, int] = {}
    labels, doc_words, doc_counts, sizes = [], [], [], []
    for text, label in rows:
        found = [index.setdefault(w, len(index)) for w in WORD.findall(text.lower())]
        ids, counts = np.unique(np.asarray(found, np.int32), return_counts=True)
        labels.append(label)
        doc_words.append(ids)
        doc_counts.append((counts / max(1, len(found))).astype(np.float32))
        sizes.append(len(ids))
    y = np.asarray(labels, np.int64)
    prior = (y.sum() + 1.0) / (len(y) + 2.0) if len(y) else 0.5
    start = float(np.log(prior / (1 - prior)))
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(settings.buckets, np.float32), start, settings)
    packed, lengths = array("i"), array("i")
    for word in index:
        own = subwords(word, settings)
        packed.extend(own)
        lengths.append(len(own))
    del index
    flat, grams = np.frombuffer(packed, np.int32), np.frombuffer(lengths, np.int32).astype(np.int64)
    first = np.concatenate(([0], np.cumsum(grams)))
    rng = np.random.default_rng(settings.seed)
    E = rng.normal(0, 1.0 / settings.dim, (settings.buckets, settings.dim)).astype(np.float32)
    W = rng.normal(0, 0.1, (settings.dim, 2)).astype(np.float32)
    b = np.array([0.0, start], np.float32)
    gE, gW, gb = np.full_like(E, 1e-6), np.full_like(W, 1e-6), np.full_like(b, 1e-6)
    order = np.arange(len(y))
    for epoch in range(settings.epochs):
        rng.shuffle(order)
        rate = settings.rate * (1 - epoch / settings.epochs)
        for at in range(0, len(order), settings.batch):
            docs = [d for d in order[at : at + settings.batch] if sizes[d]]
            if not docs:
                continue
            owner = np.repeat(np.arange(len(docs)), [sizes[d] for d in docs])
            share = np.concatenate([doc_counts[d] for d in docs])
            words, local = np.unique(np.concatenate([doc_words[d] for d in docs]), return_inverse=True)
            n = grams[words]
            ends = np.cumsum(n)
            gram = flat[np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat(first[words], n)]
            vectors = np.add.reduceat(E[gram], ends - n, axis=0) / n[:, None]
            means = settings.gain * np.stack([np.bincount(owner, share * vectors[local, k], len(docs)) for k in range(settings.dim)], 1)
            logits = means @ W + b
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(docs)), y[docs]] -= 1
            p /= len(docs)
            dW, db = means.T @ p, p.sum(0)
            up = (settings.gain * (p @ W.T)).astype(np.float32)
            dwords = np.stack([np.bincount(local, share * up[owner, k], len(words)) for k in range(settings.dim)], 1) / n[:, None]
            spread = np.repeat(dwords, n, axis=0)
            dE = np.stack([np.bincount(gram, spread[:, k], settings.buckets) for k in range(settings.dim)], 1) + settings.decay * E
            for weight, square, grad in ((E, gE, dE), (W, gW, dW), (b, gb, db)):
                square += grad * grad
                weight -= (rate * grad / np.sqrt(square)).astype(np.float32)
    return Model((E @ (W[:, 1] - W[:, 0])).astype(np.float32), float(b[1] - b[0]), settings)


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Train on at most settings.sample labelled rows of docs, those whose ids hash lowest; of several labels of an id the highest
    counts, of several texts of an id the least. The sample, bounded in rows and in characters, is read by one task, which trains;
    the driver gets ids and lengths of it and the finished table, but no text."""
    ids = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    order = F.xxhash64(F.lit(settings.seed), "_id")
    chosen = ids.orderBy(order, "_id").limit(settings.sample)
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    rows = cut(texts.join(F.broadcast(chosen), "_id").groupBy("_id", "_y").agg(F.min("_text").alias("_text")))
    sizes = rows.select("_id", F.char_length("_text").alias("n")).orderBy(order, "_id").collect()
    fitting, used = [], 0
    for r in sizes:
        if used + r["n"] <= settings.sample_chars:
            used += r["n"]
            fitting.append(r["_id"])
    wanted = rows if len(fitting) == len(sizes) else rows.where(F.col("_id").isin(fitting))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = train(((batch.column(0)[i].as_py(), batch.column(1)[i].as_py()) for batch in batches for i in range(batch.num_rows)), settings)
        yield pa.RecordBatch.from_arrays([pa.array([model.table.tobytes()], pa.binary()), pa.array([model.bias], pa.float64())], names=["table", "bias"])

    learned = wanted.coalesce(1).sortWithinPartitions("_id").select("_text", "_y").mapInArrow(learn, "table binary, bias double").collect()
    forget(rows)
    return Model(np.frombuffer(learned[0]["table"], np.float32), learned[0]["bias"], settings) if learned else train((), settings)


def score(docs: DataFrame, model: Model, text_col: str = "text", into: str = "score") -> DataFrame:
    """docs with one more column, the probability of the toxic class; a column of docs with its very name gives way."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in sliced(batches):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            values = own.score([t or "" for t in texts])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(values, pa.float64())], names=[*batch.schema.names[:-1], into])
        own.words.clear()

    kept = docs.select(*[c for c, name in zip(every(docs), docs.columns, strict=True) if name.lower() != into.lower()])
    schema = T.StructType([*kept.schema.fields, T.StructField(into, T.DoubleType())])
    text = F.col("`" + text_col.replace("`", "``") + "`")
    return docs.select(*every(kept), text.cast("string").alias(fresh(docs, "_scored"))).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the id as text is divisible by five."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
