"""Exact dedup, Jaccard join and repeated substrings against brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import exact_dedup, jaccard_join, suffix_dedup


def _as_counter(df, columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def _copies(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[text or ""].append(doc_id)
    out = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        out.update((i, keep, len(ids), keep is None or i == keep, sha) for i in ids)
    return out


@pytest.mark.parametrize("name", ["edge", "small", "nothing"])
def test_exact_copies(request, name):
    df = request.getfixturevalue(name)
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    got = _as_counter(exact_dedup.mark_copies(df, salts=3), ["doc_id", "keep_id", "group_size", "kept", "text_sha256"])
    assert got == _copies(rows)
    assert exact_dedup.unique(df).count() == len({t or "" for _, t in rows})


def test_exact_copies_plan_has_no_python(small):
    plan = exact_dedup.mark_copies(small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def _sets(rows):
    out = []
    for doc_id, text, *_ in rows:
        w = (text or "").encode().lower().split()
        out.append((doc_id, {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    return out


def _components(rows):
    sets = _sets(rows)
    group = list(range(len(sets)))
    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            inter = len(a & b)
            if inter and 100 * inter >= 75 * (len(a) + len(b) - inter):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for (doc_id, _), g in zip(sets, group):
        if doc_id is not None:
            least[g] = min(doc_id, least.get(g, doc_id))
    return Counter((doc_id, len(s), least.get(g)) for (doc_id, s), g in zip(sets, group))


@pytest.mark.parametrize("name", ["edge", "small", "nothing"])
def test_jaccard_components(request, name):
    df = request.getfixturevalue(name)
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    got = _as_counter(jaccard_join.link_documents(df), ["doc_id", "n_shingles", "component_id"])
    assert got == _components(rows)


def test_jaccard_chains_and_recursion(spark, monkeypatch):
    """A chain of near copies is one component although its ends are not linked; regions recurse."""
    words = [f"w{i}" for i in range(400)]
    rows = []
    for k in range(40):
        text = words[:]
        for j in range(k):
            text[3 * j] = f"c{j}"
        rows.append((100 - k, " ".join(text), "en", "a", 1))
    rows += [(200 + k, " ".join(words[:100] + [f"u{k}_{i}" for i in range(200)]), "en", "a", 1) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = _components(rows)
    for leaf in (1000, 4):
        monkeypatch.setattr(jaccard_join, "LEAF", leaf)
        got = _as_counter(jaccard_join.link_documents(df), ["doc_id", "n_shingles", "component_id"])
        assert got == want


def test_sets_that_share_a_digest_stay_apart(small, small_rows, monkeypatch):
    """With a first digest of a few bits nearly all sets share it; the second one tells them apart."""
    monkeypatch.setattr(jaccard_join, "DIGEST", 15)
    got = _as_counter(jaccard_join.link_documents(small), ["doc_id", "n_shingles", "component_id"])
    assert got == _components(small_rows)


def test_keep_one_keeps_columns_and_one_of_each_group(edge):
    kept = jaccard_join.keep_one(edge)
    assert kept.columns == edge.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids[4] == 1 and ids[5] == ids[6] == 0 and ids[7] == 1 and ids[1] == ids[2] == ids[3] == 1


def _cut(rows, length=400):
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    seen = Counter(t[k:k + length] for _, t in texts for k in range(len(t) - length + 1))
    out = Counter()
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if seen[t[k:k + length]] > 1:
                gone[k:k + length] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out[i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("name", ["edge", "small", "nothing"])
def test_repeated_substrings(request, name, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 50_000)
    df = request.getfixturevalue(name)
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    got = _as_counter(suffix_dedup.remove_repeats(df), ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    assert got == _cut(rows)


def test_repeats_of_every_length_near_the_bound(spark):
    """Shared strings of 380 to 440 bytes at all offsets, in pairs and triples, and periodic texts."""
    rng = np.random.default_rng(3)
    noise = lambda n: "".join(chr(97 + x) for x in rng.integers(26, size=n))
    rows, doc_id = [], 0
    for length in (380, 399, 400, 401, 420, 440, 700):
        shared = noise(length)
        for copies in range(2 + length % 2):
            rows.append((doc_id, noise(int(rng.integers(0, 300))) + shared + noise(int(rng.integers(0, 300)))))
            doc_id += 1
    core = noise(500)
    rows += [(900, core), (901, core[:450]), (902, core[50:]), (903, noise(40) + core), (904, "ab" * 700), (905, "z" * 399)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = _as_counter(suffix_dedup.remove_repeats(df), ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    assert got == _cut(rows)


def test_repeat_spans_and_kept_text(spark):
    text = "".join(chr(97 + i * i % 26) + chr(97 + i % 23) for i in range(300))
    df = spark.createDataFrame([(1, "left " + text), (2, text + " right")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(df, keep_text=True).collect()}
    assert bytes(got[1]["kept"]) == b"left " and got[2]["spans"] == [[0, 600]]
    assert df.where(F.col("doc_id") == 1).count() == 1
