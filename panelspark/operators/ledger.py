"""Append-only ledger of finished fits: a restarted run repeats only what is open.

Each row is the score of one fit, keyed by everything that decides it: the
site's rows, the feature set, the parameters, the seed and the held-out fold.
Scores are appended wave by wave as Parquet below the ledger's folder, so the
results of a search can be read while it runs.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_path
from .codes import CodeMatrix
from .forests import LOCAL_ROWS, Fit, score_ahead, score_fits, steps_ahead

ROW = "key string, site string, spec string, train_r2 double, test_r2 double, importances array<struct<k:bigint,v:double>>"
WAVE = 250                            # fits of one job: what a lost driver repeats at most


@dataclass(frozen=True)
class Score:
    train_r2: float | None
    test_r2: float | None
    importances: dict[str, float]


class Ledger:
    """Scores of fits, from ``path`` if given (a shared folder), else from a fresh folder below the checkpoint folder.

    No later run reads a fresh folder. There a chain of fits, each known only by the score of the one before, is
    followed some steps in a task instead of one job a step.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, wave: int = WAVE):
        self.spark, self.path, self.wave, self.named = spark, path or scratch_path(spark, "fit-ledger"), wave, path is not None
        self.ahead: dict[str, Score] = {}

    def key(self, matrix: CodeMatrix, fit: Fit) -> str:
        spec = fit.spec(matrix.features)
        named = spec | {"features": sorted(fit.features), "rows": matrix.stamps[fit.site], "site": fit.site}
        return hashlib.sha256(json.dumps(named, sort_keys=True).encode()).hexdigest()

    def table(self) -> DataFrame:
        """All scores written so far."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], ROW)
        return self.spark.read.schema(ROW).parquet(self.path)

    def scores(self, matrix: CodeMatrix, fits: list[Fit], with_importances: bool = True, following=None) -> list[Score]:
        """The score of each fit; those that the ledger lacks are fitted, ``wave`` at a time (one small row a fit).

        ``following(fit, importances)``: the fit that will be asked for next, if it depends on this one alone, or None.
        """
        keys = [self.key(matrix, f) for f in fits]
        if following is not None and not self.named:
            self._run_ahead(matrix, [f for f, k in zip(fits, keys) if k not in self.ahead], following)
        if all(k in self.ahead for k in keys):
            return [self.ahead[k] for k in keys]
        known = self._known(set(keys), matrix)
        open_ = [i for i, k in enumerate(keys) if k not in known]
        for at in range(0, len(open_), self.wave):
            part = open_[at:at + self.wave]
            names = self.spark.createDataFrame(
                [(n, keys[i], fits[i].site, json.dumps(fits[i].spec(matrix.features))) for n, i in enumerate(part)],
                "fit long, key string, site string, spec string")
            scored = score_fits(matrix, [fits[i] for i in part]).join(F.broadcast(names), "fit")
            kept = F.col("importances") if with_importances else F.lit(None)
            scored = scored.withColumn("importances", kept.cast("array<struct<k:bigint,v:double>>"))
            scored.select(*[c.split()[0] for c in ROW.split(", ")]).coalesce(1).write.mode("append").parquet(self.path)
        if open_:
            known = self._known(set(keys), matrix)
        return [known[k] for k in keys]

    def _run_ahead(self, matrix: CodeMatrix, fits: list[Fit], following) -> None:
        """Scores of fits on sites that fit a task, and of those that follow them, added to the ledger (a small row a fit)."""
        fits = [f for f in fits if matrix.sizes[f.site] <= LOCAL_ROWS]
        steps = steps_ahead(matrix, fits) if fits else 0
        if steps < 2:
            return
        made = cut_lineage(score_ahead(matrix, fits, following, steps))
        named = [(r, replace(fits[r["fit"]], features=tuple(r["features"]))) for r in made.collect()]
        rows = [(self.key(matrix, f), f.site, json.dumps(f.spec(matrix.features)), r["train_r2"], r["test_r2"], r["importances"])
                for r, f in named]
        self.spark.createDataFrame(rows, ROW).coalesce(1).write.mode("append").parquet(self.path)
        self.ahead |= {k: Score(train, test, {matrix.features[i["k"]]: i["v"] for i in x}) for k, _, _, train, test, x in rows}

    def _known(self, keys: set[str], matrix: CodeMatrix) -> dict[str, Score]:
        named = lambda x: {matrix.features[i["k"]]: i["v"] for i in x or ()}
        wanted = self.spark.createDataFrame([(k,) for k in sorted(keys)], "key string")
        found = self.table().join(F.broadcast(wanted), "key").dropDuplicates(["key"]).collect()
        return {r["key"]: Score(r["train_r2"], r["test_r2"], named(r["importances"])) for r in found}
