"""Quality classifier: random-indexing word vectors and a small calibrated network.

Every token has a sparse ternary index vector given by its hash. A vocabulary
token's word vector is the normalised sum of the index vectors of its
neighbours in all training texts; other tokens use their own index vector.
A document pools its token vectors (count-weighted mean) with a few pooled
counts. A two-layer numpy network maps the pooled features to a logit, and a
temperature fitted on held-back training rows calibrates the probability.

Vocabulary and word vectors come from the whole texts of every document outside
the held-out fold, labelled or not. Only the network and its temperature are
fitted on a bounded, hash-chosen sample of labelled rows (about
``sample_rows``); every document is scored. The model that is broadcast has a
fixed size (``VOCABULARY`` and ``BUCKETS`` rows of ``DIMENSIONS``).

Defined results: null text is empty and is scored like any text; rows without
a label are not learned from; several labels of one id count as their largest;
without labels of both classes the score is the labels' mean (0.5 without
any); other columns are ignored.
"""

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .brown import frequent_tokens
from .common import Scratch, fold, tidy

DIMENSIONS, NONZERO, BUCKETS, VOCABULARY = 64, 8, 1 << 14, 20_000
CONTEXT = 2
SAMPLE_ROWS = 8_000
FIT_TASKS = 8
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 60, 128, 3e-3, 1e-4
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
POOLED = 8
SLICE = 256                        # texts that are Python strings at a time
TOKENS = 8_000                     # tokens whose windows are summed at a time: 16-bit sums of 2 * CONTEXT signs each
WIDTH = BUCKETS + 1                # index vectors, and an empty one
FLUSH_TOKENS, STRIP = 400_000, 2048


def tokens_of(text: str) -> list[str]:
    """Words, numbers and runs of symbols; capitals are told by a shape token."""
    out = []
    for t in TOKEN.findall(text):
        if len(t) > 1 and t.isupper():
            out.append("<CAPITALS>")
        out.append(t.lower())
    return out


def index_vectors(seed: int = 10) -> np.ndarray:
    """Sparse ternary index vector of each hash bucket."""
    rng = np.random.default_rng(seed)
    table = np.zeros((BUCKETS, DIMENSIONS), np.float32)
    at = np.argsort(rng.random((BUCKETS, DIMENSIONS)), axis=1)[:, :NONZERO]
    np.put_along_axis(table, at, rng.choice(np.float32([-1, 1]), (BUCKETS, NONZERO)), axis=1)
    return table / np.sqrt(np.float32(NONZERO))


def bucket(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % BUCKETS


@dataclass
class Model:
    vocabulary: dict = field(default_factory=dict)
    vectors: np.ndarray | None = None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    layers: list | None = None
    temperature: float = 1.0
    constant: float | None = None

    def pooled(self, text: str) -> np.ndarray:
        found = tokens_of(text)
        counts = Counter(found)
        n = max(1, len(found))
        out = np.zeros(DIMENSIONS + POOLED, np.float32)
        if not found:
            return out
        known = self.vocabulary
        rows = [known[t] if t in known else VOCABULARY + bucket(t) for t in counts]
        weights = np.fromiter(counts.values(), np.float32, len(counts))
        out[:DIMENSIONS] = weights @ self.vectors[rows] / n
        symbols = sum(c for t, c in counts.items() if not t[0].isalnum() and t != "<CAPITALS>")
        digits = sum(c for t, c in counts.items() if t[0].isdigit())
        out[DIMENSIONS:] = (np.linalg.norm(out[:DIMENSIONS]), np.log1p(n), len(counts) / n, weights.max() / n,
                            symbols / n, digits / n, counts.get("<CAPITALS>", 0) / n,
                            sum(len(t) * c for t, c in counts.items()) / n / 10)
        return out

    def logits(self, x: np.ndarray) -> np.ndarray:
        (w1, b1), (w2, b2) = self.layers
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2[:, 0] + b2[0]

    def probability(self, texts) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        x = np.array([self.pooled(t) for t in texts], np.float32).reshape(-1, DIMENSIONS + POOLED)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int, id_col: str, text_col: str) -> DataFrame:
    """(text, label, back): a hash-chosen sample of labelled rows outside the held-out fold."""
    labelled = (labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull())
                .where(fold(F.col(id_col), FOLDS) != HELD_OUT)
                .groupBy(F.col(id_col).alias("_id")).agg(F.max("quality").cast("double").alias("label")))
    share = min(1.0, sample_rows / max(1, labelled.count()))
    place = F.pmod(F.xxhash64("_id", F.lit("quality")), F.lit(1_000_000))
    chosen = labelled.where(place < int(share * 1_000_000)).withColumn(
        "back", F.pmod(F.xxhash64("_id", F.lit("back")), F.lit(5)) == 0)
    return (docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
            .join(F.broadcast(chosen), "_id").select("text", "label", "back"))


def training_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The whole texts outside the held-out fold, labelled or not."""
    return docs.where(fold(F.col(id_col), FOLDS) != HELD_OUT).select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def _vocabulary(texts: DataFrame) -> dict[str, int]:
    """Numbers of the ``VOCABULARY`` most frequent tokens of all training texts."""
    def batch_of(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([t.encode("utf-8", "surrogatepass") for t in seen], pa.binary()),
                                           pa.array(list(seen.values()), pa.int64())], ["token", "n"])

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                for text in batch.column("text").slice(at, SLICE).to_pylist():
                    seen.update(tokens_of(text))
                    if len(seen) > FLUSH_TOKENS:
                        yield batch_of(seen)
                        seen = Counter()
        yield batch_of(seen)

    counts = (texts.mapInArrow(tidy(count), "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")).where("n > 1"))
    scratch = Scratch(texts.sparkSession, "quality-counts")
    top = frequent_tokens(scratch.write(counts, "counts"), VOCABULARY)
    scratch.drop("counts")
    return {t.decode("utf-8", "surrogatepass"): i for i, (t, _) in enumerate(top)}


class TokenNumbers(dict):
    """(place in the vocabulary + 1) * WIDTH + bucket of the tokens met."""

    def __init__(self, known: dict[str, int]):
        super().__init__()
        self.known = known

    def __missing__(self, token: str) -> int:
        if len(self) > FLUSH_TOKENS:
            self.clear()
        value = self[token] = (self.known.get(token, -1) + 1) * WIDTH + bucket(token)
        return value


def _add_windows(sums: np.ndarray, numbers: np.ndarray, signs: np.ndarray) -> None:
    """Add to ``sums`` the neighbours' index vectors of the vocabulary tokens, ``TOKENS`` at a time.

    Texts stand between ``CONTEXT`` tokens of the empty bucket. The sums of ``TOKENS`` tokens fit 16 bits.
    """
    for begin in range(0, len(numbers), TOKENS):
        a, end = max(0, begin - CONTEXT), min(len(numbers), begin + TOKENS)
        vectors = signs[numbers[a:end + CONTEXT] % WIDTH]
        around = np.zeros_like(vectors)
        for step in range(1, CONTEXT + 1):
            around[:-step] += vectors[step:]
            around[step:] += vectors[:-step]
        rows = numbers[begin:end] // WIDTH - 1
        order = np.argsort(rows)
        order = order[np.searchsorted(rows, 0, sorter=order):]
        if len(order):
            mine = rows[order]
            first = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
            sums[mine[first]] += np.add.reduceat(around[begin - a:end - a][order].astype(np.int16), first, axis=0)


def _context_sums(texts: DataFrame, vocabulary: dict, index: np.ndarray) -> np.ndarray:
    """Sum of the neighbours' index vectors of every vocabulary token, over all training texts.

    Index vectors are summed as integers, so the sums do not depend on the order of rows. A task adds up one
    (vocabulary, dimensions) matrix and sends strips of it, which are added by strip.
    """
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary)
    signs = np.vstack([np.sign(index), np.zeros((1, DIMENSIONS))]).astype(np.int8)

    def add(batches):
        number, sums = TokenNumbers(shared.value).__getitem__, np.zeros((VOCABULARY, DIMENSIONS), np.int64)
        between, held, size = np.full(CONTEXT, BUCKETS), [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                for text in batch.column("text").slice(at, SLICE).to_pylist():
                    found = tokens_of(text)
                    held += (np.fromiter(map(number, found), np.int64, len(found)), between)
                    size += len(found)
                    if size >= TOKENS:
                        _add_windows(sums, np.concatenate(held), signs)
                        held, size = [], 0
        if held:
            _add_windows(sums, np.concatenate(held), signs)
        parts = [(at, sums[at:at + STRIP]) for at in range(0, VOCABULARY, STRIP)]
        parts = [(at, part.tobytes()) for at, part in parts if part.any()]       # the exchange compresses them
        yield pa.RecordBatch.from_arrays([pa.array([at for at, _ in parts], pa.int64()),
                                          pa.array([part for _, part in parts], pa.binary())], ["at", "strip"])

    def merge(key, table):
        total = sum(np.frombuffer(s, np.int64) for s in table.column("strip").to_pylist())
        return pa.table({"at": pa.array([key[0].as_py()], pa.int64()), "strip": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros((VOCABULARY, DIMENSIONS))
    for r in (texts.mapInArrow(tidy(add), "at long, strip binary").groupBy("at").applyInArrow(merge, "at long, strip binary").collect()):
        part = np.frombuffer(r["strip"], np.int64).reshape(-1, DIMENSIONS)
        out[r["at"]:r["at"] + len(part)] = part
    shared.destroy()
    return out


def _train(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> list:
    """Two dense layers (tanh, logistic) by Adam on mini-batches."""
    params = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
              rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 1)), np.zeros(1)]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            rows = order[at:at + BATCH]
            hidden = np.tanh(x[rows] @ params[0] + params[1])
            out = 1 / (1 + np.exp(-np.clip(hidden @ params[2] + params[3], -40, 40)))
            err = (out - y[rows, None]) / len(rows)
            back = err @ params[2].T * (1 - hidden ** 2)
            grads = [x[rows].T @ back + DECAY * params[0], back.sum(0), hidden.T @ err + DECAY * params[2], err.sum(0)]
            step += 1
            for i, g in enumerate(grads):
                m[i] += 0.1 * (g - m[i])
                v[i] += 0.001 * (g * g - v[i])
                params[i] -= RATE * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.999 ** step)) + 1e-8)
    return [(params[0], params[1]), (params[2], params[3])]


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id",
        text_col: str = "text", seed: int = 10) -> Model:
    scratch = Scratch(docs.sparkSession, "quality")
    sample = scratch.write(training_rows(docs, labels, sample_rows, id_col, text_col).repartition(3 * FIT_TASKS), "sample")
    index, model = index_vectors(seed), Model()
    texts = training_texts(docs, id_col, text_col)
    model.vocabulary = _vocabulary(texts)
    sums = _context_sums(texts, model.vocabulary, index)
    size = np.linalg.norm(sums, axis=1, keepdims=True)
    model.vectors = np.vstack([(sums / np.where(size > 0, size, 1)).astype(np.float32), index])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def pool(frames):
        for f in frames:
            yield pd.DataFrame({"x": [shared.value.pooled(t).tobytes() for t in f["text"]],
                                "label": f["label"], "back": f["back"]})

    rows = sample.mapInPandas(pool, "x binary, label double, back boolean").toPandas()
    scratch.drop("sample")
    y = rows["label"].to_numpy(float)
    if len(np.unique(y)) < 2:
        model.constant = float(y.mean()) if len(y) else 0.5
        return model
    x = np.array([np.frombuffer(b, np.float32) for b in rows["x"]]).astype(np.float64)
    order = np.lexsort(x.T[:6])                      # the fit does not depend on the order of rows
    x, y, back = x[order], y[order], rows["back"].to_numpy(bool)[order]
    if len(np.unique(y[back])) < 2:
        back[:] = False
    model.mean, model.scale = x[~back].mean(0), x[~back].std(0) + 1e-3
    model.layers = _train((x[~back] - model.mean) / model.scale, y[~back], np.random.default_rng(seed))
    if back.any():
        z = model.logits(x[back])

        def loss(t: float) -> float:
            p = np.clip(1 / (1 + np.exp(-np.clip(z / t, -40, 40))), 1e-9, 1 - 1e-9)
            return -float(np.mean(y[back] * np.log(p) + (1 - y[back]) * np.log(1 - p)))

        model.temperature = min(np.geomspace(0.5, 8, 60), key=loss)
    return model


def score_column(model: Model, docs: DataFrame, text: Column) -> Column:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(arrays):
        for texts in arrays:
            parts = [shared.value.probability(texts.slice(at, SLICE).to_pylist()) for at in range(0, len(texts), SLICE)]
            yield pa.array(np.concatenate(parts) if parts else [], pa.float64())

    @F.arrow_udf("double")
    def score(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from tidy(scores)(arrays)

    return score(F.coalesce(text.cast("string"), F.lit("")))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  threshold: float = THRESHOLD, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per document."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, **options)
    scored = docs.select(F.col(id_col).alias("doc_id"), (fold(F.col(id_col), FOLDS) == HELD_OUT).alias("held_out"),
                         score_column(model, docs, F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              threshold: float = THRESHOLD, **options) -> DataFrame:
    """The documents that the classifier accepts, with all their columns."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, **options)
    return docs.where(score_column(model, docs, F.col(text_col)) >= threshold)
