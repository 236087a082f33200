"""The registered queries against their SQL, and the pipeline against its operators."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from panelspark.llm import queries
from tests.llm.test_corpus import _hits, _targets_by_hand
from tests.llm.test_sets import _sets

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.SQL[name])
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    as_text = lambda rows: sorted(tuple(str(x) for x in r) for r in rows)
    assert as_text(got.select(*want.columns).collect()) == as_text(want.fetchall())


def test_all_operators_are_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "jaccard_join", "decontamination", "source_mix", "jump_shards"]
    good = stages["quality_classifier"](spark, docs, SF)
    one = stages["jaccard_join"](spark, good, SF)
    clean = stages["decontamination"](spark, one, SF)
    mixed = stages["source_mix"](spark, clean, SF)
    assert all(df.columns == docs.columns for df in (good, one, clean, mixed))
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    kept = ids(clean)
    assert set(kept) <= set(ids(one)) <= set(ids(good)) <= set(ids(docs)) and len(set(kept)) == len(kept)
    assert set(ids(mixed)) <= set(kept)
    out = corpus_pipeline.run(spark, SF)
    assert ids(out) == ids(mixed) and {"shard", "slot", "text", "source"} <= set(out.columns)


def _written(base, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{base}/{name}.parquet")
    return base


LABELS = "doc_id long, quality int, toxic int"


def test_pipeline_on_edge_rows(spark, edge, tmp_path):
    """Nulls in every column, empty and very long texts, copies, repeated rows and clashing columns: every stage returns
    the columns of its input, unchanged, for rows it was given."""
    docs = edge
    for name in ("_row", "_number", "_size", "n_words", "items", "label", "fingerprint", "whole", "number"):
        docs = docs.withColumn(name, F.lit(5))
    labels = spark.createDataFrame([(4, 1, 0), (7, 0, 0), (None, 1, 0), (9, None, 0), (8, 1, 0), (8, 0, 0), (14, 0, 0)], LABELS)
    benchmark = spark.createDataFrame([(1, "Only three words"), (None, None), (2, "")], "item_id long, text string")
    sf = _written(f"file://{tmp_path}/sf", documents=docs, labels=labels, benchmark=benchmark)
    read, stages = spark.read.parquet(f"{sf}/documents.parquet"), dict(corpus_pipeline.STAGES)
    given = Counter(tuple(r) for r in read.collect())
    for name, stage in list(stages.items())[:4]:
        out = stage(spark, read, sf)
        assert out.columns == read.columns
        rows = Counter(tuple(r) for r in out.collect())
        assert set(rows) <= set(given)
        if name == "jaccard_join":
            assert all(n == 1 for n in rows.values())
        if name == "decontamination":
            assert {r[0] for r in given} - {r[0] for r in rows} == {9, 10}
    last = corpus_pipeline.run(spark, sf)
    assert {"shard", "slot", "grown_shard"} <= set(last.columns) and last.count() > 0


def test_pipeline_on_empty_tables(spark, nothing, tmp_path):
    sf = _written(f"file://{tmp_path}/sf", documents=nothing, labels=spark.createDataFrame([], LABELS),
                  benchmark=spark.createDataFrame([], "item_id long, text string"))
    assert corpus_pipeline.run(spark, sf).collect() == []


def test_pipeline_equals_brute_force_behind_the_classifier(spark, small):
    """Which rows each stage keeps, by brute force over what its predecessor kept."""
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_classifier"](spark, small, SF).cache()
    rows = [tuple(r) for r in good.select("doc_id", "text").collect()]
    sets = _sets(rows)
    group = list(range(len(rows)))
    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            n = len(a & b)
            if n and 100 * n >= 75 * (len(a) + len(b) - n):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    first = {}
    for (doc_id, _), g in zip(rows, group):
        first[g] = min(doc_id, first.get(g, doc_id))
    one = stages["jaccard_join"](spark, good, SF).cache()
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(first.values())
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    kept = [(r["doc_id"], r["text"]) for r in one.collect()]
    want = {k[0] for k in _hits(kept, items) if not k[5]}
    clean = stages["decontamination"](spark, one, SF).cache()
    assert {r["doc_id"] for r in clean.collect()} == want
    mixed = stages["source_mix"](spark, clean, SF).cache()
    sizes = Counter()
    for r in clean.collect():
        sizes[r["source"]] += len((r["text"] or "").split())
    target = _targets_by_hand(sizes)
    got = Counter()
    for r in mixed.collect():
        got[r["source"]] += len((r["text"] or "").split())
    largest = max(len((r["text"] or "").split()) for r in clean.collect())
    assert all(abs(got[s] - target[s]) <= largest for s in sizes)
    dealt = stages["jump_shards"](spark, mixed, SF).collect()
    assert Counter(r["doc_id"] for r in dealt) == Counter(r["doc_id"] for r in mixed.collect())
    for shard in range(24):
        slots = sorted(r["slot"] for r in dealt if r["shard"] == shard)
        assert slots == list(range(len(slots)))
