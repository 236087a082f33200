"""Decontamination, WARC, mixing, sharding, scoring and classifiers."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from panelspark.llm import brown, decontaminate, jaccard_join, langid, mixing, quality, sharding, simhash, warc

BENCH = "item_id long, text string"


def _hits(rows, items):
    out = Counter()
    parsed = [(str(i) if i is not None else "", decontaminate.words_of((t or "").encode())) for i, t in items]
    for doc_id, text, *_ in rows:
        words, hit, found = decontaminate.words_of((text or "").encode()), set(), set()
        for item, w in parsed:
            size = min(10, len(w))
            grams = {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if w else set()
            for i in range(len(words) - size + 1):
                if tuple(words[i:i + size]) in grams:
                    hit.update(range(i, i + size))
                    found.add(item)
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[doc_id, len(words), len(hit), len(found), sha, bool(hit)] += 1
    return out


HIT_COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


@pytest.mark.parametrize("name", ["edge", "small", "nothing"])
def test_contamination(request, spark, name):
    df = request.getfixturevalue(name)
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text")
    words = (rows[0][1] or "" if rows else "").split()
    items = [tuple(r) for r in bench.collect()] + [(900, "three words"), (901, None), (902, "--"), (None, "日本語"),
                                                   (903, " ".join(words[3:20])), (10, "W1 w2"), (903, "same same same")]
    benchmark = spark.createDataFrame(items, BENCH)
    got = Counter(tuple(r) for r in decontaminate.contamination(df, benchmark).select(HIT_COLUMNS).collect())
    assert got == _hits(rows, items)
    clean = decontaminate.drop_contaminated(df, benchmark)
    assert clean.columns == df.columns and clean.count() == sum(n for k, n in got.items() if not k[5])


def test_contamination_without_items(spark, small):
    out = decontaminate.contamination(small, spark.createDataFrame([], BENCH))
    assert out.where("contaminated").count() == 0 and out.count() == small.count()


def test_contamination_in_benchmark_blocks(spark, small, monkeypatch):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    whole = Counter(tuple(r) for r in decontaminate.contamination(small, bench).select(HIT_COLUMNS).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 100)
    assert Counter(tuple(r) for r in decontaminate.contamination(small, bench).select(HIT_COLUMNS).collect()) == whole


def test_proximity(spark):
    df = spark.createDataFrame([(1, "alpha x x beta"), (2, "alpha x x x x beta"), (3, "beta alpha"), (4, "alpha"),
                                (5, "beta")], "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["n_matches"] for r in decontaminate.near_matches(
        decontaminate.build_index(df), ["Alpha", "beta"], 4).collect()}
    assert got == {1: 1, 3: 1}


def _page_rows(rows):
    first = {}
    for page_id, _, html in rows:
        if page_id is not None:
            first[html or ""] = min(page_id, first.get(html or "", page_id))
    out = Counter()
    for page_id, _, html in rows:
        data, keep = (html or "").encode(), first.get(html or "")
        same = keep is None or page_id == keep
        out[page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
            "response" if same else "revisit", None if same else keep] += 1
    return out


PAGE_COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    monkeypatch.setattr(warc, "LINES_PER_BLOCK", 3)
    rows = [(1, "http://a.example/x", "WARC/1.1\r\n\r\nhi"), (2, "http://a.example/x", "WARC/1.1\r\n\r\nhi"),
            (3, None, None), (4, "", ""), (None, "bad url http://[", "solo"), (None, "http://A.example:8/Q?b=1#f", "WARC/1.1\r\n\r\nhi"),
            (6, "http://é.example/\r\nInjected: 1", "É" * 40_000), (7, "u" * 900, "x"), (7, "u" * 900, "x"), (8, "u" * 901, "x")]
    rows += [(100 + i, f"https://h{i % 5}.example.org/{i % 7}", f"<p>{i % 11}</p>" * 30) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(3)
    back = warc.round_trip(pages)
    assert Counter(tuple(r) for r in back.select(PAGE_COLUMNS).collect()) == _page_rows(rows)
    assert Counter(r["url"] for r in back.collect()) == Counter(r[1] for r in rows)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_archives_are_plain_gzip_streams(spark, tmp_path):
    import gzip
    pages = spark.createDataFrame([(i, f"http://x.example/{i}", f"page {i}") for i in range(5)],
                                  "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, f"file://{tmp_path}/w")
    data = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "w").rglob("part-*")))
    assert data.count(b"WARC/1.1\r\n") == 5 and data.endswith(b"\r\n\r\n") and b"page 4" in data


def test_ranges_are_read_alone(spark, tmp_path, monkeypatch):
    """Lookups read the wanted records' bytes only; whole archives are read where tasks cannot open the store."""
    rows = [(i, f"http://x{i % 3}.example/{i}", f"page {i} " * 200) for i in range(40)]
    path = f"file:{tmp_path}/w"
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2), path)
    lines = warc.captures(spark, path).where("key like 'example,x1)%'").cache()
    out = warc.read_ranges(spark, path, lines)
    assert "content#" not in out._jdf.queryExecution().optimizedPlan().toString().split("InMemoryRelation")[0]
    want = {(i, html) for i, _, html in rows if i % 3 == 1}
    assert {(r["page_id"], bytes(r["payload"]).decode()) for r in out.collect()} == want
    monkeypatch.setattr(warc, "_ranged", lambda p: False)
    assert {(r["page_id"], bytes(r["payload"]).decode()) for r in warc.read_ranges(spark, path, lines).collect()} == want


def test_neighbouring_ranges_are_one_read(monkeypatch):
    monkeypatch.setattr(warc, "GAP", 10)
    monkeypatch.setattr(warc, "READ_BYTES", 100)
    got = list(warc._joined([(0, 20), (25, 30), (70, 40), (200, 500), (705, 5)]))
    assert got == [(0, 55, [(0, 20), (25, 30)]), (70, 40, [(70, 40)]), (200, 500, [(200, 500)]), (705, 5, [(705, 5)])]
    assert list(warc._joined([])) == []


def test_url_key():
    assert warc.url_key("HTTPS://Blog.Example.com:80/a?b=c#d") == "com,example,blog)/a?b=c"
    assert warc.url_key(None) == "" and warc.url_key("nohost") == "nohost"


def test_mix_targets_share_and_cap():
    targets = mixing.mix_targets([10, 1000, 1000], [5, 2, 1], 1.5, 2)
    assert targets == pytest.approx([20, 2995 * 2 / 3, 2995 / 3])
    assert mixing.mix_targets([], [], 1.5, 2) == [] and mixing.mix_targets([0, 0], [5, 2], 1.5, 2) == [0, 0]


def _targets_by_hand(sizes, ratio=1.5, most=2):
    """Targets by filling: raise all open sources' share together until the next one is full, in small exact steps."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(order, Fraction(0)), Fraction(ratio) * sum(sizes.values()), [s for s in order if sizes[s]]
    while left > 0 and open_:
        total = sum(weight[s] for s in open_)
        step = min([left / total, *((most * sizes[s] - target[s]) / weight[s] for s in open_)])
        for s in open_:
            target[s] += step * weight[s]
        left -= step * total
        open_ = [s for s in open_ if target[s] < most * sizes[s]]
    return {s: float(t) for s, t in target.items()}


@pytest.mark.parametrize("name", ["edge", "small", "nothing"])
def test_mix(request, name):
    """Targets recomputed by hand; what is taken misses them by less than any document that could close the gap."""
    df = request.getfixturevalue(name)
    rows = [tuple(r) for r in df.select("doc_id", "text", "lang", "source").collect()]
    sizes = Counter()
    for _, text, _, source in rows:
        sizes[source] += len((text or "").encode().split())
    want = _targets_by_hand(sizes)
    planned = mixing.plan_mix(df).cache()
    out = planned.select("source", "size", "source_size", "target", F.size("draws").alias("copies"), "draws").collect()
    assert len(out) == len(rows)
    got, free = Counter(), {}
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["copies"] <= 2 and all(0 <= d < 16 for d in r["draws"])
        got[r["source"]] += r["size"] * r["copies"]
        if r["copies"] < 2 and r["size"]:
            free.setdefault(r["source"], []).append(r["size"])
    for s in sizes:
        gap = want[s] - got[s]
        assert abs(gap) <= 0.05 * want[s] or abs(gap) <= min(free.get(s, [0])) or gap < 0 and -gap <= max(r["size"] for r in out if r["source"] == s) / 2
        if gap > 0.05 * want[s]:                               # nothing that may be taken once more comes nearer
            assert all(abs(gap - x) >= gap for x in free.get(s, []))
    copies = lambda rs: sorted((str(r[0]), r[1], r[4]) for r in rs)
    taken = mixing.taken(df).collect()
    assert copies(taken) == copies(mixing.taken(df.repartition(3)).collect()) and sum(r["taken"] for r in taken) == sum(got.values())
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r["copies"] for r in out)


def test_mix_in_many_blocks_comes_near(spark, monkeypatch):
    monkeypatch.setattr(mixing, "DOCS_PER_BLOCK", 8)
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * max(1, int(rng.lognormvariate(3, 1)))), rng.choice("aaaaabbbc")) for i in range(900)]
    out = mixing.plan_mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for r in out.groupBy("source").agg(F.sum(F.col("size") * F.size("draws")).alias("got"), F.max("target").alias("want")).collect():
        assert abs(r["got"] - r["want"]) <= 0.01 * r["want"]


def test_stages_return_the_users_columns_unchanged(spark):
    """Columns with the operators' own names come back as they went in."""
    rows = [(i, f"word{i % 4} " * (5 + i), "ab"[i % 2], *[777] * 9) for i in range(12)]
    names = ("size", "source_size", "target", "draws", "_row", "_number", "_h", "_doc", "number")
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} long" for n in names))
    benchmark = spark.createDataFrame([(1, "word1 " * 10)], BENCH)
    for out in (mixing.mix(df), jaccard_join.keep_one(df), simhash.keep_one(df), decontaminate.drop_contaminated(df, benchmark)):
        assert out.columns == df.columns and out.count() > 0
        assert {tuple(r) for r in out.select(*names).collect()} == {(777,) * 9}


def test_splitting_tree_is_exact():
    quotas = np.array([100, 0, 7, 1000])
    parts = mixing.splitting_tree(quotas, 6, np.random.default_rng(1))
    assert (parts.sum(1) == quotas).all() and (parts >= 0).all()
    assert parts.sum(0).max() - parts.sum(0).min() <= 3


def _jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2 ** 64
        j = int((b + 1) * (2 ** 31 / ((key >> 33) + 1)))
    return b


def test_jump_hash():
    keys = np.random.default_rng(0).integers(0, 2 ** 63, 500, dtype=np.uint64) * np.uint64(2)
    for n in (1, 2, 24, 25, 1000):
        assert sharding.jump_hash(keys, n).tolist() == [_jump(int(k), n) for k in keys]
    old, new = sharding.jump_hash(keys, 24), sharding.jump_hash(keys, 25)
    assert (new[new != old] == 24).all()


@pytest.mark.parametrize("name", ["edge", "small", "nothing"])
def test_shards(request, name, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_BLOCK", 2)
    df = request.getfixturevalue(name)
    out = sharding.assign_shards(df, 24).collect()
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in
                   ((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
    slots, by_id = {}, {}
    for r in out:
        assert r["law"] == "key" and 0 <= r["shard"] < 24 and r["grown_shard"] in (r["shard"], 24)
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert by_id.setdefault(r["doc_id"], r["shard"]) == r["shard"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_write_shards(small, tmp_path, spark):
    sharding.write_shards(small, f"file://{tmp_path}/s", 5)
    back = spark.read.parquet(f"file://{tmp_path}/s")
    assert back.count() == small.count() and {"shard", "text", "slot"} <= set(back.columns)


@pytest.mark.parametrize("name", ["edge", "small", "nothing"])
def test_brown_scores(request, name, monkeypatch):
    monkeypatch.setattr(brown, "HEAD", 1500)                  # most tokens meet their counts in the join
    df = request.getfixturevalue(name)
    texts = [(i, (t or "").encode().lower().split()) for i, t in
             ((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())]
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 10 == 0
    counts = Counter()
    for i, words in texts:
        if not held(i):
            counts.update(words)
            counts[None] += 1                                  # the end token
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), held(i), len(w) + 1, sum(counts[x] > 0 for x in [*w, None]), n, round(sum(
        math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in [*w, None]), 4)) for i, w in texts)
    out = brown.score_texts(df).collect()
    got = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"],
                  round(r["base_score"], 4)) for r in out)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(abs(g[5] - w[5]) <= 1e-3 for g, w in zip(got, want))
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in out)


def test_brown_distributions_sum_to_one():
    rng = np.random.default_rng(2)
    bigrams = rng.poisson(0.02, (brown.SYMBOLS, brown.SYMBOLS)).astype(float)
    label = brown.exchange(bigrams, sweeps=1)
    table = brown.transition_table(bigrams, label, np.ones(brown.SUFFIXES))
    assert np.allclose((10 ** table[::97]).sum(1), 1)
    assert (label[:-1] < brown.CLASSES - 1).all() and label[-1] == brown.CLASSES - 1


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(5)
    true = np.arange(60) % 3
    flow = np.array([[1, 20, 1], [1, 1, 20], [20, 1, 1]])
    bigrams = np.zeros((61, 61))
    bigrams[:60, :60] = rng.poisson(flow[np.ix_(true, true)])
    bigrams[:60, 60] = bigrams[60, :60] = 1
    label = brown.exchange(bigrams, classes=4, sweeps=10)
    for c in range(3):
        assert len(set(label[:60][true == c])) == 1


def test_language_lattice_equals_enumeration():
    pieces = ["a", "b", "ab", "ba", "aba", langid.MARK, langid.MARK + "a", langid.MARK + "ab"]
    lattice = langid.Lattice(pieces)
    p = np.random.default_rng(0).random((lattice.none + 1, 2))
    p[lattice.none] = 0

    def total(word):
        if not word:
            return np.ones(2)
        out = np.zeros(2)
        for k in range(1, len(word) + 1):
            row = lattice.number.get(word[:k], lattice.unknown if k == 1 else lattice.none)
            out = out + p[row] * total(word[k:])
        return out

    words = ["ababa", "b", "abz", "baab"]
    got = lattice.log_probability(words, p)
    assert np.allclose(got, [np.log(total(langid.MARK + w)) for w in words])
    uses = lattice.expected(["abab"], np.array([[2.0, 1.0]]), p)
    assert (uses >= 0).all() and uses[:, 0].sum() > 0


def test_long_runs_are_summed_whole():
    """Runs beyond any block: the scaled sums equal the plain recursion in logs, and expected uses add up."""
    pieces = ["a", "b", "ab", "ba", "aba", "abab", langid.MARK, langid.MARK + "a", langid.MARK + "ab"]
    lattice = langid.Lattice(pieces)
    p = np.random.default_rng(1).random((lattice.none + 1, 3)) * 1e-4
    p[lattice.none] = 0
    rng = random.Random(0)
    words = ["".join(rng.choice("abz") for _ in range(n)) for n in (1, 15, 16, 17, 24, 25, 100, 100, 700)]

    def log_total(word):
        logs = [np.zeros(3)]
        for j in range(1, len(word) + 1):
            ways = []
            for i in range(max(0, j - lattice.widest), j):
                row = lattice.number.get(word[i:j], lattice.unknown if j == i + 1 else None)
                if row is not None:
                    ways.append(logs[i] + np.log(p[row]))
            logs.append(np.logaddexp.reduce(ways))
        return logs[-1]

    assert np.allclose(lattice.log_probability(words, p), [log_total(langid.MARK + w) for w in words])
    uses = lattice.expected(words, np.ones((len(words), 3)), p)
    lengths = np.array([len(x) for x in pieces] + [1, 0])
    assert np.allclose(lengths @ uses, sum(len(w) + 1 for w in words))    # every letter is in one piece of each segmentation


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert out.where("lang = lang_pred").count() >= 0.97 * out.count()


def test_language_edges(edge, nothing):
    out = langid.identify_languages(edge).collect()
    assert len(out) == 17 and all(0 <= r["score"] <= 1 for r in out)
    assert all(r["lang_pred"] == "und" for r in out if r["doc_id"] in (1, 2, 3))
    assert langid.identify_languages(nothing).count() == 0
    unlabelled = langid.identify_languages(edge.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in unlabelled.collect()} == {"und"}


def test_quality_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = quality.score_quality(docs, labels).join(labels, "doc_id").where("held_out")
    assert out.where("predicted = quality").count() >= 0.93 * out.count()


def test_quality_edges(spark, edge, nothing):
    kinds = "doc_id long, quality int, toxic int, score double"
    labels = spark.createDataFrame([(i, int(i % 2), 0, 0.5) for i in range(1, 15)] + [(None, 1, 0, 0.1), (4, None, 0, 0.1),
                                                                                (4, 1, 0, 0.1)], kinds)
    out = quality.score_quality(edge, labels).collect()
    assert len(out) == 17 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out)
    assert quality.score_quality(nothing, labels).count() == 0
    none = quality.score_quality(edge, spark.createDataFrame([], kinds)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.keep_good(edge, labels).columns == edge.columns


def test_best_classes_are_the_exchange_gains():
    """The argmax over the changed cells is that of the whole likelihood, token by token."""
    rng = np.random.default_rng(4)
    words, classes = 30, brown.CLASSES
    bigrams = rng.poisson(0.6, (words, words)).astype(float)
    label = rng.integers(0, classes - 1, words)
    label[:12] = 3

    def between(of):
        member = np.eye(classes)[of]
        return member.T @ bigrams @ member

    contexts = np.zeros((words, brown.CONTEXTS), np.int64)
    for w in range(words):
        for x in range(words):
            if x == w:
                contexts[w, brown.ITSELF] = bigrams[w, w]
            else:
                contexts[w, brown.AFTER + label[x]] += bigrams[w, x]
                contexts[w, brown.BEFORE + label[x]] += bigrams[x, w]
    got = brown.best_classes(contexts, label, between(label))
    for w in range(words):
        tried = {c: brown.likelihood(between(np.where(np.arange(words) == w, c, label))) for c in set(label.tolist())}
        assert abs(tried[got[w]] - max(tried.values())) < 1e-6


def _watch(monkeypatch, words):
    """The classes of all training tokens and the models of later calls of ``score_texts``."""
    kept, models, cluster = {}, [], brown.cluster
    of_hash = {xxhash.xxh3_64_intdigest(w.encode()): w.encode() for w in words}

    def keep(scratch, shards, names, rare_uses):
        model = cluster(scratch, shards, names, rare_uses)
        kept.update(zip(names, model.label.tolist()))
        for row in brown._with_answers(shards, model.answers).collect():
            shard = brown.Shard(row.asDict(), len(names))
            told = [a.asDict() for a in row["answers"]]
            classes, counts = shard.told(model.label, told, model.buckets, model.use_old)
            kept.update((of_hash[h], c) for h, c, n in zip(shard.hashes.tolist(), classes.tolist(), counts.tolist()) if n)
        models.append(model)
        return model

    monkeypatch.setattr(brown, "cluster", keep)
    return kept, models


@pytest.mark.parametrize("sweeps_kept", [True, False])
def test_brown_score_equals_brute_force(spark, small, monkeypatch, sweeps_kept):
    """The score of every document from the classes alone: class bigrams, masses and emissions counted by hand."""
    monkeypatch.setattr(brown, "CLUSTERED", 200)
    monkeypatch.setattr(brown, "END", 200 + brown.SUFFIXES)
    monkeypatch.setattr(brown, "SYMBOLS", 201 + brown.SUFFIXES)
    monkeypatch.setattr(brown, "HEAD", 500)
    monkeypatch.setattr(brown, "SHARD_TOKENS", 3000)
    monkeypatch.setattr(brown, "BUCKET_TOKENS", 2000)
    told = iter([1.0, 0.0, 1.0, 0.0] if sweeps_kept else [1.0, 0.0, 0.0, 1.0])     # or the second sweep is taken back
    monkeypatch.setattr(brown, "likelihood", lambda between: next(told))
    texts = {r["doc_id"]: (r["text"] or "").encode().lower().split() for r in small.select("doc_id", "text").collect()}
    kept, models = _watch(monkeypatch, {w.decode() for t in texts.values() for w in t})
    out = brown.score_texts(small).collect()
    label, held = models[0].label, lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    assert models[0].use_old != sweeps_kept
    train = [t for i, t in texts.items() if not held(i)]
    counts = Counter(w for t in train for w in t)
    assert set(kept) == set(counts)
    rare, end = len(label) - 1 - brown.SUFFIXES, len(label) - 1
    group = lambda w: int(label[rare + brown.suffix_symbol(w) - brown.CLUSTERED])
    of = lambda w: kept.get(w, group(w))
    between, mass = np.zeros((brown.CLASSES,) * 2), np.zeros(brown.CLASSES)
    for t in train:
        path = [int(label[end]), *map(of, t), int(label[end])]
        np.add.at(between, (path[:-1], path[1:]), 1)
    assert np.array_equal(between, models[0].between)
    for w, n in counts.items():
        mass[of(w)] += n + 0.1
    for g in range(brown.SUFFIXES):
        mass[label[rare + g]] += 0.1
    mass[label[end]] += len(train) + 0.1
    steps = (between + brown.BACKOFF * mass / mass.sum()) / (between.sum(1, keepdims=True) + brown.BACKOFF)
    for r in out:
        path = [int(label[end]), *map(of, texts[r["doc_id"]]), int(label[end])]
        want = sum(math.log10(steps[a, b]) for a, b in zip(path, path[1:]))
        want += sum(math.log10((counts[w] + 0.1) / mass[of(w)]) for w in texts[r["doc_id"]]) + math.log10(
            (len(train) + 0.1) / mass[label[end]])
        assert abs(r["score"] - want) < 1e-6 * max(1, abs(want))


@pytest.mark.parametrize("head", [60, 100_000])
def test_brown_classes_follow_the_contexts(spark, monkeypatch, head):
    """Tokens beyond the exchange get the class of tokens in the same contexts, whatever their endings."""
    monkeypatch.setattr(brown, "CLUSTERED", 20)
    monkeypatch.setattr(brown, "END", 20 + brown.SUFFIXES)
    monkeypatch.setattr(brown, "SYMBOLS", 21 + brown.SUFFIXES)
    monkeypatch.setattr(brown, "HEAD", head)
    rng = random.Random(3)
    often, seldom = [10] * 10, [1] * 100
    kinds = [[f"{k}w{i * 7919 % 1000:03d}" for i in range(110)] for k in "ab"]
    docs = [(i, " ".join(rng.choices(kinds[j % 2], often + seldom)[0] for j in range(200)), None, None, 0)
            for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    kept, models = _watch(monkeypatch, {w for kind in kinds for w in kind})
    out = brown.score_texts(df).collect()
    assert len(kept) == 220 and len(out) == 120
    first, second = (Counter(kept[w.encode()] for w in kind) for kind in kinds)
    assert sum(max(first[c], second[c]) for c in first | second) >= 0.95 * 220     # 220 tokens by their class's kind
    mine = np.mean([r["score"] - r["base_score"] for r in out if r["held_out"]])
    assert mine > 200 * 0.25                               # alternation is worth log10(2) a token


def test_frequent_tokens_fill_the_head_among_ties(spark, monkeypatch):
    monkeypatch.setattr(brown, "HEAD", 300)
    counts = spark.createDataFrame([(f"t{i}".encode(), 9 if i < 20 else 5) for i in range(1000)], "token binary, n long")
    head = brown.frequent_tokens(counts)
    assert 270 <= len(head) <= 300 and [n for _, n in head[:21]] == [9] * 20 + [5]
    assert 270 <= len(brown.frequent_tokens(counts.where("n = 5"))) <= 300
    assert head == brown.frequent_tokens(counts.repartition(7))


def test_word_vectors_sum_all_training_texts(spark, monkeypatch):
    """The context sums equal a token-by-token count over every text outside the held-out fold, across chunk borders."""
    monkeypatch.setattr(quality, "TOKENS", 7)
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["alpha", "Beta", "GAMMA", "d,", "12", "e"]) for _ in range(rng.randrange(30)))) for i in range(60)]
    texts = quality.training_texts(spark.createDataFrame(rows + [(99, None)], "doc_id long, text string"), "doc_id", "text")
    vocabulary, index = quality._vocabulary(texts), quality.index_vectors()
    kept = [quality.tokens_of(t) for i, t in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    counts = Counter(t for found in kept for t in found)
    assert set(vocabulary) == {t for t, n in counts.items() if n > 1}
    want = np.zeros((quality.VOCABULARY, quality.DIMENSIONS))
    for found in kept:
        for i, t in enumerate(found):
            for j in range(max(0, i - 2), min(len(found), i + 3)):
                if j != i:
                    want[vocabulary[t]] += np.sign(index[quality.bucket(found[j])])
    assert np.array_equal(quality._context_sums(texts.repartition(3), vocabulary, index), want)
