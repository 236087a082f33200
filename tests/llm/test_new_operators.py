"""SimHash links, prefix trie and fill-in-middle against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from panelspark.llm import components, fim, prefix_trie, simhash
from panelspark.llm.common import Scratch


def _grouped(n, linked):
    group = list(range(n))
    for i, j in linked:
        old, new = group[i], group[j]
        group = [new if g == old else g for g in group]
    return group


def _fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _simhash(rows):
    prints = [_fingerprint(text) for _, text in rows]
    group = _grouped(len(rows), [(i, j) for i, a in enumerate(prints) for j, b in enumerate(prints[:i])
                                 if (a ^ b).bit_count() <= 2])
    least = {}
    for (doc_id, _), g in zip(rows, group):
        if doc_id is not None:
            least[g] = min(doc_id, least.get(g, doc_id))
    return Counter((doc_id, f"{p:016x}", least.get(g)) for (doc_id, _), p, g in zip(rows, prints, group))


@pytest.mark.parametrize("name", ["edge", "small", "nothing"])
def test_simhash_components(request, name):
    df = request.getfixturevalue(name)
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    got = Counter(tuple(r) for r in simhash.link_documents(df).select("doc_id", "fingerprint", "component_id").collect())
    assert got == _simhash(rows)


def test_simhash_keep_one(edge):
    kept = simhash.keep_one(edge)
    assert kept.columns == edge.columns
    want = {c for _, _, c in _simhash([tuple(r) for r in edge.select("doc_id", "text").collect()])}
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(want)


def test_fingerprint_spark_hash_and_blocks(spark, monkeypatch):
    """The shingle hash is Spark's own xxhash64, and long texts are counted in blocks."""
    assert np.int64(np.uint64(xxhash.xxh64_intdigest(b"one two three", 42))) == spark.range(1).select(
        F.xxhash64(F.lit("one two three"))).first()[0]
    text = " ".join(f"W{i % 977}" for i in range(5000))
    monkeypatch.setattr(simhash, "HASHES", 100)
    assert simhash.fingerprint(text.encode()) == _fingerprint(text)


def _near_points(seed=3, bases=12, each=40):
    rng = np.random.default_rng(seed)
    out = [0]
    for base in rng.integers(1 << 63, size=bases):
        for _ in range(each):
            flips = rng.choice(63, rng.integers(0, 6), replace=False)
            out.append(int(base) ^ sum(1 << int(k) for k in flips))
    return sorted(set(out))


def test_pivot_tables_lose_no_link(spark, monkeypatch):
    """Regions, splits of large regions and windows give all links of dense groups."""
    points = _near_points()
    a, b = simhash.linked_pairs(np.array(points, np.uint64))
    pairs = [(i, j) for i, x in enumerate(points) for j, y in enumerate(points[:i]) if (x ^ y).bit_count() <= 2]
    assert {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist())} == {(j, i) for i, j in pairs}
    monkeypatch.setattr(simhash, "LEAF", 6)
    monkeypatch.setattr(simhash, "PAIRS", 50)
    scratch = Scratch(spark, "test-simhash")
    frame = spark.createDataFrame([(p,) for p in points], "point long").repartition(5)
    got = {r["point"]: r["label"] for r in components.components(simhash.links(frame, scratch), scratch).collect()}
    groups = _grouped(len(points), pairs)
    pairs_of = lambda label: {frozenset(x) for x in _classes(label).values() if len(x) > 1}
    assert pairs_of(got) == pairs_of(dict(zip(points, groups)))


def _classes(label):
    out = defaultdict(set)
    for point, g in label.items():
        out[g].add(point)
    return out


def test_groups_cover_all_bits():
    for mask in ((1 << 64) - 1, 0b1011, (1 << 43) - 1 << 5):
        parts = simhash.groups_of(mask)
        assert sum(parts) == mask and len(parts) == 3 and all(x & y == 0 for x in parts for y in parts if x is not y)


@pytest.mark.parametrize("finish", [1_000_000, 100, 0])
def test_components_of_chains_stars_and_random_links(spark, monkeypatch, finish):
    monkeypatch.setattr(components, "FINISH_LINKS", finish)
    monkeypatch.setattr(components, "FOREST_LINKS", 40)
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(300)] + [(1000, 1001 + i) for i in range(300)] + [(7, 7), (5, 4), (5, 4)]
    names = {x: rng.randrange(-1 << 62, 1 << 62) for link in links for x in link}
    links += [(2000 + rng.randrange(200), 2000 + rng.randrange(200)) for _ in range(150)]
    links = [(names.get(a, a), names.get(b, b)) for a, b in links]
    df = spark.createDataFrame(links, "a long, b long").repartition(4)
    got = {r["point"]: r["label"] for r in components.components(df, Scratch(spark, "test-components")).collect()}
    points = sorted({x for link in links for x in link if link[0] != link[1]})
    at = {p: i for i, p in enumerate(points)}
    group = _grouped(len(points), [(at[a], at[b]) for a, b in links if a != b])
    assert set(got) == set(points)
    assert {frozenset(c) for c in _classes(got).values()} == {frozenset(c) for c in _classes(dict(zip(points, group))).values()}
    empty = components.components(df.where("false"), Scratch(spark, "test-components"))
    assert empty.collect() == []


# ------------------------------------------------------------------ prefix trie
def _trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            named = f"{len(role.encode())}:{role}{text}"
            own[conv].append((turn is not None, turn or 0, hashlib.md5(named.encode()).hexdigest(), role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        whole[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(set)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].add(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    leaves, saved = Counter(), Counter()
    for node, who in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(who) - 1) * (len(node[-1][1]) if node else 0)
    return Counter(
        (min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(children[node]), leaves[node], saved[node],
         hashlib.sha256(",".join(map(str, sorted(c for c in who if whole[c] == node))).encode()).hexdigest())
        for node, who in members.items())


def _conversations():
    rng = random.Random(11)
    say = lambda: (rng.choice(["user", "assistant", None, ""]), rng.choice(["hi", "", None, "日本 x", "longer words " * 9]))
    rows = []
    for c in [*range(0, 40), *range(100, 130), 205, 207, 333, 399, -5, -100, -107]:
        if c == 7:
            continue
        shared = [("user", "hi"), ("assistant", "hello"), ("user", "again")]
        turns = shared[:rng.randrange(4)] + [say() for _ in range(rng.randrange(1, 6))]
        rows += [(c, i, *t) for i, t in enumerate(turns)]
    rows += [(7, i, "user", f"turn {i // 2}") for i in range(400)] + [(8 + 600, i, "user", f"turn {i // 2}") for i in range(390)]
    rows += [(c, i, "user", f"copy {i}") for c in range(700, 760) for i in range(12)]
    rows += [(None, 0, "user", "nobody"), (20, None, "user", "first"), (21, 0, "user", "tie"), (21, 0, "user", "tie"), (22, 0, "a", "tie")]
    rng.shuffle(rows)
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("load", [4, 1])
def test_prefix_trie(spark, monkeypatch, load):
    """Nulls, ties, copies, absent heads, a conversation of many range partitions; a narrow sketch changes nothing."""
    rows = _conversations()
    monkeypatch.setattr(prefix_trie, "LOAD", load)
    monkeypatch.setattr(prefix_trie, "SHARD", 50)
    monkeypatch.setattr(prefix_trie, "ENDS", 16)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for name in ("chain", "depth", "conv", "parent", "chars", "n_convs"):
        df = df.withColumn(name, F.lit(None).cast("string"))
    got = prefix_trie.trie(df)
    assert got.columns == prefix_trie.COLUMNS
    assert Counter(tuple(r) for r in got.collect()) == _trie(rows)


def test_prefix_trie_false_alarms(spark, monkeypatch):
    """A sketch of 64 cells takes nearly all prefixes for shared: the exact grouping decides alone."""
    rows = _conversations()
    monkeypatch.setattr(prefix_trie, "LEAST_WIDTH", 64)
    monkeypatch.setattr(prefix_trie, "LOAD", 0)
    got = prefix_trie.trie(spark.createDataFrame(rows, SCHEMA))
    assert Counter(tuple(r) for r in got.collect()) == _trie(rows)


@pytest.mark.parametrize("rows", [[], [(105, 0, "user", "dropped")], [(None, 0, "a", "b")]])
def test_prefix_trie_without_turns(spark, rows):
    got = prefix_trie.trie(spark.createDataFrame(rows, SCHEMA))
    assert Counter(tuple(r) for r in got.collect()) == (_trie(rows) if rows and rows[0][0] else Counter())


def test_prefix_trie_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert Counter(tuple(r) for r in prefix_trie.trie(df).collect()) == _trie([tuple(r) for r in df.select(*SCHEMA.replace(" long", "").replace(" string", "").split(", ")).collect()])


# ------------------------------------------------------------------ fill in middle
def _fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n, digest = len(units), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}"), sha(text)
    return doc_id, n, "psm", len(p), len(m), sha(f"<P>{p}<S>{s}<M>{m}"), sha(text)


@pytest.mark.parametrize("name", ["edge", "small", "nothing"])
def test_fill_in_middle(request, name):
    df = request.getfixturevalue(name)
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    got = Counter(tuple(r) for r in fim.fim_digests(df).collect())
    assert got == Counter(_fim(*r) for r in rows)


def test_rotation_in_small_blocks(monkeypatch):
    """Cuts, swaps and inverse rotations over many block borders, with the characters of the sentinels in the text."""
    monkeypatch.setattr(fim, "BLOCK", 7)
    rng, forms = random.Random(1), Counter()
    for k in range(1500):
        text = "".join(rng.choice("ab Zé日<P>S\n-ⅷ") for _ in range(rng.randrange(60)))
        data, h = text.encode(), fim.draws(k)
        n, form = fim.count_units(data), fim.form_of(data, h)
        low, high = fim.unit_offsets(data, *sorted((h[0] % (n + 1), h[1] % (n + 1))))
        out = bytes(fim.transform(data, low, high, form))
        assert (k, n, form, hashlib.sha256(out).hexdigest()) == tuple(_fim(k, text)[i] for i in (0, 1, 2, 5))
        assert fim.restore(out, form) == data
        forms[form] += 1
    assert min(forms[f] for f in ("plain", "psm", "spm")) > 50
