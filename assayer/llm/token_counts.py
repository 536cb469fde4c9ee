"""Token counts: unigram scores by dynamic programming over a trie of distinct pre-tokens.

A pre-token is a run of characters other than white space, with the word mark of the vocabulary before it. Its best
segmentation maximises the sum of unigram scores; the forward score of a prefix depends on the prefix alone, so words that
share a prefix share it. Sorted words visit the trie depth first: the state kept is the path from the root to the current
node, and a word continues from the depth that it shares with the word before. The token count of a terminal is stored
and documents add up the counts of their words.

The vocabulary is a public one that carries ranks, not probabilities; Zipf's law gives scores, -log(rank + 1) - log(H). A
character outside it costs one token for each of its UTF-8 bytes.

Defined results: a null or empty text, or one of white space, has no words and no tokens. Repeated rows count alike, a null
id is kept, a table without rows gives none, other columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

MARK = "▁"
CACHE_WORDS = 500_000
CACHED_LENGTH = 48
CHARS_AT_ONCE = 4_000_000


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def unigram_scores(path: str) -> dict[str, float]:
    """Piece -> log probability by Zipf's law over the vocabulary's own order; control and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    ids.sort(key=lambda i: (-model.get_score(i), i))
    total = math.log(sum(1.0 / (r + 2) for r in range(len(ids))))
    return {model.id_to_piece(i): -math.log(r + 2) - total for r, i in enumerate(ids)}


def terminal_counts(words: Iterable[str], scores: dict[str, float]) -> dict[str, int]:
    """Tokens of the best segmentation of each word; at equal scores the one with fewer tokens."""
    longest = max(map(len, scores), default=1)
    fallback = min(scores.values(), default=-1.0) - 1.0
    best, count, out, before = [0.0], [0], {}, ""
    for word in sorted(set(words)):
        marked = MARK + word
        depth = 0
        for a, b in zip(before, marked, strict=False):
            if a != b:
                break
            depth += 1
        del best[depth + 1 :], count[depth + 1 :]
        for end in range(depth + 1, len(marked) + 1):
            n_bytes = len(marked[end - 1].encode("utf-8", "surrogatepass"))
            top, tokens = best[end - 1] + fallback * n_bytes, count[end - 1] + n_bytes
            for start in range(max(0, end - longest), end):
                gain = scores.get(marked[start:end])
                if gain is not None and (best[start] + gain, -count[start] - 1) > (top, -tokens):
                    top, tokens = best[start] + gain, count[start] + 1
            best.append(top)
            count.append(tokens)
        out[word] = count[len(marked)]
        before = marked
    return out


_WORKER: dict[str, tuple[dict[str, float], dict[str, int]]] = {}


def count_tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens for each row."""
    path = path or vocabulary_path()

    def totals(texts: list[str]) -> list[tuple[int, int]]:
        if path not in _WORKER:
            _WORKER[path] = (unigram_scores(path), {})
        scores, known = _WORKER[path]
        split = [t.split() for t in texts]
        words = {w for ws in split for w in ws}
        missing = [w for w in words if w not in known]
        if len(known) + len(missing) > CACHE_WORDS:
            known.clear()
            missing = list(words)
        known.update(terminal_counts(missing, scores))
        out = [(len(ws), sum(map(known.__getitem__, ws))) for ws in split]
        for w in missing:
            if len(w) > CACHED_LENGTH:
                del known[w]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, texts, size = [], [], 0
            for value in batch.column(1):
                texts.append(value.as_py() or "")
                size += len(texts[-1])
                if size >= CHARS_AT_ONCE:
                    out += totals(texts)
                    texts, size = [], 0
            out += totals(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["doc_id", "n_words", "n_tokens"])
        if path in _WORKER:
            _WORKER[path][1].clear()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_words long, n_tokens long")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir))
