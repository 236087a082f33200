"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Targets: sources in code-point order (null last) get weights in turn; the
   wanted total is shared by weight, no target passes ``max_repeat`` times its
   source, and the excess is reshared by weight until none is above.
2. Blocks: a seeded hash deals each source's documents into blocks of about
   ``DOCS_PER_BLOCK``, and a seeded affine permutation orders the blocks. A target
   is a number of whole passes over the blocks plus a prefix of the permuted
   blocks. The block at the cut is divided at document level: documents in hash
   order as far as they fit, then the largest that still fit, those that are
   taken already among them while ``max_repeat`` allows another copy, and last the
   one that ends nearest to the target. The words taken miss the target by less
   than the smallest document of that block that may be taken once more; a
   source of a few documents can only come as near as these allow.
3. Tree: the exact block quotas of all sources are split recursively between
   the two halves of the output shards by multivariate-hypergeometric draws;
   each leaf (output shard) owns disjoint ranges of the permuted blocks.
4. Within a shard, rows are ordered by a seeded hash (local shuffle).

The texts are read once into a narrow table (id, source, size, hash) from which
all decisions follow; ``mix`` reads them a second time to return whole rows. Only
one row per source reaches the driver (the mix specification). Every decision is
a function of seed, ids and texts, so reruns agree.

Defined results: null text has size 0; null is a source of its own, the last;
sources without words have target 0; a mix of nothing is empty; repeated rows
share their decisions; ``mix`` returns the input's columns as they are, whatever
their names; in ``plan_mix`` result columns win over input columns of the same name.
"""

from math import gcd

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, utf8

WEIGHTS = (5.0, 2.0, 1.0)
DOCS_PER_BLOCK = 1024
MOST_BROADCAST = 100_000            # sources whose rows are broadcast; more meet the documents in a shuffle
RESULTS = ("size", "source_size", "target", "draws")


@F.arrow_udf(T.LongType())
def count_words(texts: pa.Array) -> pa.Array:
    return pa.array([len(t.as_py().split()) for t in texts], pa.int64())


def mix_targets(sizes: list[int], weights: list[float], ratio: float, max_repeat: float) -> list[float]:
    """Share ``ratio`` of all sizes by weight; capped targets give their excess to the others."""
    target, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = ratio * sum(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / total > max_repeat * sizes[i]}
        if not over:
            for i in open_:
                target[i] = left * weights[i] / total
            break
        for i in over:
            target[i] = float(max_repeat * sizes[i])
        open_ -= over
        left = ratio * sum(sizes) - sum(target)
    return target


def splitting_tree(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """(sources, shards) block counts: rows sum to the quotas, columns to near-equal totals."""
    if shards == 1:
        return quotas.reshape(-1, 1)
    left = shards // 2
    n_left = int(quotas.sum()) * left // shards
    drawn = rng.multivariate_hypergeometric(quotas, n_left, method="marginals") if n_left else np.zeros_like(quotas)
    return np.hstack([splitting_tree(drawn, left, rng), splitting_tree(quotas - drawn, shards - left, rng)])


def _cut_rule(max_repeat: int):
    def rule(rest: pd.DataFrame) -> pd.DataFrame:
        """Which documents of the block at the cut to take once more: hashes up to ``cut``, and ``extras``."""
        rest = rest.sort_values(["h", "size"], kind="stable").reset_index(drop=True)
        left, passes = float(rest["left"].iloc[0]), int(rest["passes"].iloc[0])
        size, h = rest["size"].to_numpy(), rest["h"].to_numpy()
        fits = np.cumsum(size) <= left
        n = int(np.argmin(fits)) if not fits.all() else len(fits)
        while 0 < n < len(h) and h[n - 1] == h[n]:          # equal hashes are taken together or not at all
            n -= 1
        left -= float(size[:n].sum())
        # by hash: the words of all its rows, largest first; those before the cut could get a second copy
        weight: dict[int, int] = {}
        for x, words in zip(h.tolist(), size.tolist()):
            weight[x] = weight.get(x, 0) + int(words)
        pool = {x: w for x, w in weight.items() if w > 0}
        copies = dict.fromkeys(pool, passes)
        for x in h[:n].tolist():
            if x in copies:
                copies[x] = passes + 1
        extras: list[int] = []
        for x in sorted(pool, key=lambda x: (-pool[x], x)):
            while pool[x] <= left and copies[x] < max_repeat:
                extras.append(x)
                copies[x] += 1
                left -= pool[x]
        open_ = [x for x in pool if copies[x] < max_repeat]
        last = min(open_, key=lambda x: (abs(left - pool[x]), x), default=None)
        if last is not None and abs(left - pool[last]) < left:
            extras.append(last)
        return pd.DataFrame({"no": [int(rest["no"].iloc[0])], "cut": [int(h[n - 1]) if n else None], "extras": [extras]})

    return rule


def _narrow(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> list:
    """(size, _h) of a row of ``docs``: its words and the seeded hash that all decisions follow."""
    text = utf8(F.col(text_col))
    return [count_words(text).alias("size"), F.xxhash64(F.lit(seed), F.col(id_col), F.crc32(text)).alias("_h")]


def _small(table: DataFrame, n: int) -> DataFrame:
    return F.broadcast(table) if n <= MOST_BROADCAST else table


def _decisions(rows: DataFrame, weights, ratio: float, max_repeat: int, shards: int, seed: int, source_type) -> tuple[DataFrame, int]:
    """(one row per source with all that decides its documents, number of sources). ``rows``: _source, size, _h."""
    spark = rows.sparkSession
    stats = rows.groupBy("_source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")).collect()
    stats = sorted(stats, key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [int(r["words"]) for r in stats]
    targets = mix_targets(sizes, [weights[i % len(weights)] for i in range(len(stats))], ratio, max_repeat)
    rng = np.random.default_rng(seed)
    spec = []
    for i, (r, s, t) in enumerate(zip(stats, sizes, targets)):
        n = int(max(1, r["n"] // DOCS_PER_BLOCK))
        a = next(x for x in iter(lambda: int(rng.integers(1, n + 1)), None) if gcd(x, n) == 1)
        passes = min(max_repeat, int(t // s)) if s else 0
        spec.append((i, r[0], s, float(t), n, a, int(rng.integers(n)), passes, float(t - passes * s)))
    fields = [("no", T.IntegerType()), ("_key", source_type), ("source_size", T.LongType()),
              ("target", T.DoubleType()), ("blocks", T.LongType()), ("a", T.LongType()), ("c", T.LongType()),
              ("passes", T.IntegerType()), ("left", T.DoubleType())]
    spec_df = spark.createDataFrame(spec, T.StructType([T.StructField(*f) for f in fields]))
    ranked = _ranked(rows, spec_df, len(spec))
    words = {r["no"]: (r["_rank"], int(r["w"])) for r in _block_cuts(ranked)}
    cuts = {s[0]: words.get(s[0], (0, 0)) for s in spec}
    cut_df = spark.createDataFrame([(i, int(c[0]), float(spec[i][8] - c[1])) for i, c in cuts.items()], "no int, cut_rank long, rest double")
    at_cut = (ranked.select("no", "_rank", "_h", "size", "passes").join(_small(cut_df, len(cuts)), "no")
              .where("_rank = cut_rank").select("no", F.col("_h").alias("h"), "size", F.col("rest").alias("left"), "passes"))
    rules = {r["no"]: r for r in at_cut.groupBy("no").applyInPandas(
        _cut_rule(max_repeat), "no int, cut long, extras array<long>").collect()}
    quotas = np.array([s[7] * s[4] + cuts[s[0]][0] + 1 for s in spec], dtype=np.int64)
    ends = np.cumsum(splitting_tree(quotas, shards, rng), axis=1) if len(spec) else np.zeros((0, shards), np.int64)
    rule_rows = [(i, int(cuts[i][0]), rules[i]["cut"] if i in rules else None,
                  list(rules[i]["extras"]) if i in rules else [], ends[i].tolist()) for i in cuts]
    rule_df = spark.createDataFrame(rule_rows, "no int, cut_rank long, cut long, extras array<long>, ends array<long>")
    return spec_df.join(rule_df, "no"), len(spec)


def _ranked(rows: DataFrame, spec: DataFrame, n: int) -> DataFrame:
    """Rows with their source's specification and the permuted number of their block."""
    return (rows.join(_small(spec, n), F.col("_source").eqNullSafe(F.col("_key")))
            .withColumn("_rank", F.pmod(F.pmod("_h", "blocks") * F.col("a") + F.col("c"), F.col("blocks"))))


def _planned(docs: DataFrame, weights, ratio, max_repeat, shards, seed, id_col, text_col, source_col, whole: bool) -> DataFrame:
    """size, source_size, target, draws and _h of every row; the row itself in the struct ``_doc`` (``whole``), else its id."""
    scratch = Scratch(docs.sparkSession, "mix")
    narrow = scratch.write(docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"),
                                       *_narrow(docs, seed, id_col, text_col, source_col)), "narrow")
    spec, n = _decisions(narrow, weights, ratio, max_repeat, shards, seed, docs.schema[source_col].dataType)
    rows = narrow if not whole else docs.select(F.struct(*docs.columns).alias("_doc"), F.col(source_col).alias("_source"),
                                                *_narrow(docs, seed, id_col, text_col, source_col))
    prefix = (F.col("_rank") < F.col("cut_rank")) | ((F.col("_rank") == F.col("cut_rank")) & F.coalesce(
        F.col("_h") <= F.col("cut"), F.lit(False)))
    more = F.size(F.filter("extras", lambda x: x == F.col("_h")))
    turns = F.least(F.col("passes") + F.when(prefix, 1).otherwise(0) + more, F.lit(max_repeat))
    draws = F.when(turns > 0, F.transform(
        F.sequence(F.lit(0), turns - 1),
        lambda e: F.least(F.size(F.filter("ends", lambda x: x <= e * F.col("blocks") + F.col("_rank"))), F.lit(shards - 1)))
    ).otherwise(F.array().cast("array<int>"))
    return _ranked(rows, spec, n).select("_doc" if whole else "_id", *RESULTS[:3], draws.alias("draws"), "_h")


def plan_mix(docs: DataFrame, weights=WEIGHTS, ratio: float = 1.5, max_repeat: int = 2, shards: int = 16,
             seed: int = 20, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """All rows and columns of ``docs`` with size, source_size, target and ``draws``.

    ``draws`` lists the output shard of each copy the mix takes of the row.
    """
    rows = _planned(docs, weights, ratio, max_repeat, shards, seed, id_col, text_col, source_col, whole=True)
    return rows.select(*[F.col("_doc")[c].alias(c) for c in docs.columns if c not in RESULTS], *RESULTS)


def _block_cuts(ranked: DataFrame) -> list:
    """Per source: the permuted block in which the words of the last pass run out, and the words before it."""
    from pyspark.sql import Window
    before = Window.partitionBy("no").orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
    return (ranked.groupBy("no", "_rank").agg(F.sum("size").alias("w"), F.first("left").alias("left"))
            .select("no", "_rank", "left", "w", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("before"))
            .where("before <= left and before + w > left")
            .groupBy("no").agg(F.min("_rank").alias("_rank"), F.min("before").alias("w")).collect())


def taken(docs: DataFrame, weights=WEIGHTS, ratio: float = 1.5, max_repeat: int = 2, shards: int = 16, seed: int = 20,
          id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, size, source_size, target, taken), one row per document."""
    rows = _planned(docs, weights, ratio, max_repeat, shards, seed, id_col, text_col, source_col, whole=False)
    return rows.select(F.col("_id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"))


def mix(docs: DataFrame, weights=WEIGHTS, ratio: float = 1.5, max_repeat: int = 2, shards: int = 16, seed: int = 20,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed rows (columns of ``docs``; repeats are rows), by output shard, shuffled inside it."""
    rows = (_planned(docs, weights, ratio, max_repeat, shards, seed, id_col, text_col, source_col, whole=True)
            .select("_doc", "_h", F.posexplode("draws").alias("_turn", "_draw"))
            .withColumn("_mix_key", F.xxhash64(F.lit(seed + 1), F.col("_h"), F.col("_turn"))))
    return rows.repartitionByRange("_draw", "_mix_key").sortWithinPartitions("_draw", "_mix_key").select("_doc.*")
