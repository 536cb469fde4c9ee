import hashlib
import random
import re
import time

import pytest

from assayer.llm import fingerprints as fp
from tests.llm.conftest import prose


def test_edits_and_likeness(spark, awkward):
    rows = awkward.where("doc_id is not null").dropDuplicates(["doc_id"])
    texts = {r.doc_id: r.text or "" for r in rows.collect()}
    order = sorted(texts, reverse=True)
    got = {r.doc_id: r for r in fp.with_edits(rows).collect()}
    assert got.keys() == texts.keys()
    for i, doc_id in enumerate(order):
        text, following = texts[doc_id], texts[order[(i + 1) % len(order)]]
        k = len(text) // 3
        edited = text[: len(text) - k] + following[:k]
        r = got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.fingerprint == r.edited_fingerprint) == (text == edited)
    assert got[11].fingerprint == got[12].fingerprint != got[13].fingerprint
    assert got[10].near_edited > 0.5


def test_repeated_null_and_empty(spark, awkward, nothing):
    got = fp.with_edits(awkward).collect()
    assert len(got) == awkward.count() and sum(r.doc_id is None for r in got) == 1
    assert fp.with_edits(nothing).count() == 0
    assert len({r.fingerprint for r in got if r.n_chars == 0}) == 1


def plain_tree(text):
    """Root, and each section as (digest, [(paragraph digest, passage digests)])."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    paragraphs = []
    for p in re.findall(fp.PARAGRAPH, text):
        leaves = [sha(x) for x in re.findall(fp.PASSAGE, p)]
        paragraphs.append((sha("".join(leaves)), leaves))
    sections, now = [], []
    for p in paragraphs:
        now.append(p)
        if p[0][-1] in "01" or len(now) == 32:
            sections.append(now)
            now = []
    sections += [now] if now else []
    return sha("".join(sha("".join(d for d, _ in s)) for s in sections)), [(sha("".join(d for d, _ in s)), s) for s in sections]


def plain_changes(a, b):
    if a == b:
        return []
    (_, sa), (_, sb) = plain_tree(a), plain_tree(b)
    da, db = {d for d, _ in sa}, {d for d, _ in sb}
    others = {d for digest, s in sb if digest not in da for d, _ in s}
    out, at = [], 0
    for digest, s in sa:
        out += [at + j for j, (d, _) in enumerate(s) if digest not in db and d not in others]
        at += len(s)
    return out


def test_tree_likeness_and_changes_against_a_plain_tree(spark, awkward):
    rng = random.Random(6)
    texts = [r.text or "" for r in awkward.collect()] + ["\n".join(prose(rng, rng.randint(0, 9)) for _ in range(200))]
    pairs = [(a, rng.choice([rng.choice(texts), a[: len(a) // 2] + "new words.\n" + a[len(a) // 2 :], "\n".join(rng.sample(a.split("\n"), len(a.split("\n"))))])) for a in texts * 2]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    df = fp.fingerprinted(fp.fingerprinted(df, "a", "fa"), "b", "fb")
    for r in df.select("i", "fa", "fb", fp.likeness("fa", "fb").alias("near"), fp.changed_paragraphs("fa", "fb").alias("changed")).collect():
        a, b = pairs[r.i]
        root, sections = plain_tree(a)
        assert r.fa == root + ":" + "/".join(d[:16] + "=" + ".".join(p[:12] + "-" + "".join(x[:6] for x in leaves) for p, leaves in s) for d, s in sections)
        x, y = ({leaf[:6] for _, s in plain_tree(t)[1] for _, leaves in s for leaf in leaves} for t in (a, b))
        assert r.near == (1.0 if a == b else 2 * len(x & y) / max(1, len(x) + len(y)))
        assert r.changed == plain_changes(a, b)


def test_branches_locate_an_edit(spark):
    a = "\n".join(f"paragraph number {i} has words." for i in range(40))
    b = a.replace("number 17 has", "number 17 had")
    df = spark.createDataFrame([(a, b)], "a string, b string")
    df = fp.fingerprinted(fp.fingerprinted(df, "a", "fa"), "b", "fb")
    r = df.select(fp.changed_paragraphs("fa", "fb").alias("c"), "fa").first()
    assert r.c == [17] and r.fa.count(".") + r.fa.count("/") == 39


def test_long_texts_cost_time_in_proportion(spark):
    def seconds(lines, end="\n"):
        text = end.join(f"line {i}." for i in range(lines))
        df = spark.createDataFrame([(text, text.replace("7.", "x."))], "a string, b string")
        df = fp.fingerprinted(fp.fingerprinted(df, "a", "fa"), "b", "fb").select(fp.changed_paragraphs("fa", "fb"), fp.likeness("fa", "fb"))
        began = time.perf_counter()
        df.collect()
        return time.perf_counter() - began

    seconds(10)
    assert seconds(80_000) < 6 * seconds(20_000)
    assert seconds(80_000, " ") < 6 * seconds(20_000, " ")


def test_native(spark, awkward):
    plan = fp.with_edits(awkward)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize(("kind", "ids"), [("long", [-(1 << 63), None, 5]), ("string", ["a", None, ""])])
def test_any_id_keeps_its_value(spark, kind, ids):
    rows = [(i, f"text number {n}. More of it.") for n, i in enumerate(ids)]
    got = fp.with_edits(spark.createDataFrame(rows, f"doc_id {kind}, text string")).collect()
    assert {r.doc_id for r in got} == set(ids) and len(got) == 3
