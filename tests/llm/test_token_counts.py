import random

from assayer.llm import token_counts as tc


def brute(word, scores):
    """Fewest tokens among the best segmentations, by trying all of them."""
    marked = tc.MARK + word
    fallback = min(scores.values()) - 1
    best = {0: (0.0, 0)}
    for end in range(1, len(marked) + 1):
        n = len(marked[end - 1].encode())
        options = [(best[end - 1][0] + fallback * n, -best[end - 1][1] - n)]
        options += [(best[s][0] + scores[marked[s:end]], -best[s][1] - 1) for s in range(end) if marked[s:end] in scores]
        top = max(options)
        best[end] = (top[0], -top[1])
    return best[len(marked)][1]


def test_shared_prefixes_change_nothing():
    scores = tc.unigram_scores(tc.vocabulary_path())
    rng = random.Random(7)
    words = ["".join(rng.choices("theraingo", k=rng.randint(1, 9))) for _ in range(300)] + ["漢字", "naïve", "x" * 60, "", "á"]
    assert tc.terminal_counts(words, scores) == {w: brute(w, scores) for w in words}


def test_documents(spark, awkward, nothing, monkeypatch):
    scores = tc.unigram_scores(tc.vocabulary_path())
    got = tc.count_tokens(awkward).collect()
    want = sorted(((r.doc_id, len((r.text or "").split()), sum(tc.terminal_counts([w], scores)[w] for w in (r.text or "").split())) for r in awkward.collect()), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert tc.count_tokens(nothing).count() == 0
