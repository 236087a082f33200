"""Language identification by segmentation-marginalised unigram models.

Each language has a probability for every piece of a fixed public vocabulary.
A word's probability in a language is the sum over all ways to cut the word
into pieces, computed by the forward algorithm; a text's is the product over
its words. Piece probabilities are fitted by expectation maximisation
(forward-backward over the word lattice) on word counts of a hash-chosen
sample of about ``sample_rows`` labelled documents a language; every document
is scored, over its whole text.

Words are runs of letters in lower case, with the vocabulary's word-start
mark, summed over in whole however long they are (a script without spaces has
clauses for words). Letters outside the vocabulary are an unknown piece. Scores of different words are
computed once and kept, so the work follows the number of different words.

Defined results: null texts and texts without a letter are ``und`` with score
0; rows without lang are not learned from; without any labelled row every
text is ``und``; languages that tie go to the first by code point; other
columns are ignored. The broadcast model has pieces x languages numbers.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fold, tidy

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_SHARE, RESCALE = 1e-3, 16
SAMPLE_ROWS, ROUNDS, PRIOR = 2_000, 3, 0.05
FOLDS, HELD_OUT = 4, 2
WORD = re.compile(r"[^\W\d_]+")
KEPT_WORDS = 400_000


def load_pieces(path: str = VOCABULARY) -> list[str]:
    """Pieces of letters (with or without the word-start mark) of the vocabulary file."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size())
              if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return sorted({p for p in pieces if p == MARK or p.removeprefix(MARK).isalpha() and p == p.lower()})


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Lattice:
    """Forward (and backward) sums over the segmentations of words, many words at a time."""

    def __init__(self, pieces: list[str]):
        self.number = {p: i for i, p in enumerate(pieces)}
        self.unknown, self.none = len(pieces), len(pieces) + 1   # rows of the probability table
        self.widest = max(map(len, pieces))

    def marked(self, word: str) -> str:
        return MARK + (word if word.isalpha() else "".join(filter(str.isalpha, word)))

    def arcs(self, words: list[str]) -> dict[tuple[int, int], np.ndarray]:
        """Piece number of every stretch (start, end) of equally long words."""
        get, n, out = self.number.get, len(words[0]), {}
        for i in range(n):
            for j in range(i + 1, min(n, i + self.widest) + 1):
                rows = [get(w[i:j], self.none) for w in words]
                if j == i + 1:
                    rows = [self.unknown if r == self.none else r for r in rows]
                rows = np.array(rows)
                if (rows != self.none).any():
                    out[i, j] = rows
        return out

    def sums(self, arcs: dict, n: int, p: np.ndarray, backward: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(n + 1, words, languages) sums over the segmentations of every prefix (or suffix), and the logs they are scaled by.

        The sums within reach of the next ones (the last ``widest``) share one scale; it is drawn into the logs every
        ``RESCALE`` letters, so a run of any length neither underflows nor is cut.
        """
        first = next(iter(arcs.values()))
        a, logs = np.zeros((n + 1, len(first), p.shape[1])), np.zeros((n + 1, len(first), p.shape[1]))
        order = range(n - 1, -1, -1) if backward else range(1, n + 1)
        a[n if backward else 0] = 1
        for done, j in enumerate(order, 1):
            reach = range(j + 1, min(n, j + self.widest) + 1) if backward else range(max(0, j - self.widest), j)
            for i in reach:
                arc = arcs.get((j, i) if backward else (i, j))
                if arc is not None:
                    a[j] += a[i] * p[arc]
            logs[j] = logs[j + 1 if backward else j - 1]
            if done % RESCALE == 0:
                window = slice(j, min(n, j + self.widest) + 1) if backward else slice(max(0, j - self.widest), j + 1)
                scale = a[window].max(0)
                a[window] /= scale
                logs[window] = logs[j] + np.log(scale)
        return a, logs

    def by_length(self, words: list[str]):
        """(length, marked words, their places), words of one length together."""
        groups: dict[int, list[int]] = {}
        marked = [self.marked(w) for w in words]
        for k, w in enumerate(marked):
            groups.setdefault(len(w), []).append(k)
        for n, places in groups.items():
            step = max(1, 4096 * 24 // n)
            for at in range(0, len(places), step):
                some = places[at:at + step]
                yield n, [marked[k] for k in some], np.array(some)

    def log_probability(self, words: list[str], p: np.ndarray) -> np.ndarray:
        out = np.zeros((len(words), p.shape[1]))
        for n, some, places in self.by_length(words):
            a, logs = self.sums(self.arcs(some), n, p)
            out[places] = np.log(np.maximum(a[n], 1e-300)) + logs[n]
        return out

    def expected(self, words: list[str], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, for words x languages counts."""
        total = np.zeros_like(p)
        for n, some, places in self.by_length(words):
            arcs = self.arcs(some)
            (a, a_logs), (b, b_logs) = self.sums(arcs, n, p), self.sums(arcs, n, p, backward=True)
            whole = np.log(np.maximum(a[n], 1e-300)) + a_logs[n]
            for (i, j), rows in arcs.items():
                share = counts[places] * np.exp(a_logs[i] + b_logs[j] - whole)
                np.add.at(total, rows, a[i] * p[rows] * b[j] * share)
        return total


class Model:
    def __init__(self, languages: list[str], lattice: Lattice, p: np.ndarray):
        self.languages, self.lattice, self.p = languages, lattice, p


def _normalised(counts: np.ndarray, unknown: int) -> np.ndarray:
    """Probabilities with a prior; an unknown letter gets a small share of its piece."""
    p = np.zeros_like(counts)
    p[:-1] = (counts[:-1] + PRIOR) / (counts[:-1] + PRIOR).sum(0)
    p[unknown] *= UNKNOWN_SHARE
    return p


def fit(docs: DataFrame, vocabulary: str = VOCABULARY, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id",
        text_col: str = "text", lang_col: str = "lang") -> Model | None:
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"),
                       F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & (fold(F.col("_id"), FOLDS) != HELD_OUT))
    found = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(found)
    if not languages:
        return None
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, sample_rows / found[lang]))])
    place = F.pmod(F.xxhash64("_id", F.lit("langid")), F.lit(1_000_000)) / F.lit(1e6)
    sample = rows.where(F.col("text").isNotNull() & (place < share[F.col("lang")])).select("text", "lang")
    lattice, number = Lattice(load_pieces(vocabulary)), {lang: i for i, lang in enumerate(languages)}

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                for word, n in Counter(words_of(text)).items():
                    seen[word, lang] += n
        yield pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in seen], pa.string()), pa.array([x for _, x in seen], pa.string()),
             pa.array(list(seen.values()), pa.int64())], ["word", "lang", "n"])

    words = Scratch(docs.sparkSession, "langid").write(
        sample.mapInArrow(tidy(count), "word string, lang string, n long").groupBy("word", "lang").agg(F.sum("n").alias("n")),
        "words")
    pieces = lattice.none + 1
    p = _normalised(np.ones((pieces, len(languages))), lattice.unknown)
    for _ in range(ROUNDS):
        shared = docs.sparkSession.sparkContext.broadcast(p)

        def expect(batches):
            total = np.zeros((pieces, len(languages)))
            for batch in batches:
                texts, langs = batch.column("word").to_pylist(), batch.column("lang").to_pylist()
                at = {w: i for i, w in enumerate(dict.fromkeys(texts))}
                counts = np.zeros((len(at), len(languages)))
                for w, x, n in zip(texts, langs, batch.column("n").to_pylist()):
                    counts[at[w], number[x]] += n
                total += lattice.expected(list(at), counts, shared.value)
            row, col = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(col, pa.int64()),
                                              pa.array(total[row, col], pa.float64())], ["piece", "lang", "n"])

        total = np.zeros_like(p)
        for r in (words.mapInArrow(tidy(expect), "piece long, lang long, n double")
                  .groupBy("piece", "lang").agg(F.sum("n").alias("n")).collect()):
            total[r["piece"], r["lang"]] = r["n"]
        shared.destroy()
        p = _normalised(total, lattice.unknown)
    return Model(languages, lattice, p)


class WordScores:
    """Log-probabilities of the words met so far (row 0: a word without letters)."""

    def __init__(self, model: Model):
        self.model, self.row, self.table = model, {}, np.zeros((1, len(model.languages)))

    def add(self, words: set[str]) -> None:
        if len(self.row) > KEPT_WORDS:
            self.row, self.table = {}, self.table[:1]
        new = [w for w in words if w not in self.row]
        with_letters = [w for w in new if w.isalpha() or any(map(str.isalpha, w))]
        self.row.update(dict.fromkeys(new, 0))
        start = len(self.table)
        self.row.update((w, start + i) for i, w in enumerate(with_letters))
        if with_letters:
            self.table = np.vstack([self.table, self.model.lattice.log_probability(with_letters, self.model.p)])

    def predict(self, words: list[str]) -> tuple[str, float]:
        rows = np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))
        if not rows.any():
            return "und", 0.0
        total = self.table[rows].sum(0)
        best = int(np.argmax(total))
        return self.model.languages[best], float(1 / np.exp(total - total[best]).sum())


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row per document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold(F.col(id_col), FOLDS) == HELD_OUT).alias("held_out"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    if model is None:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        scores = WordScores(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [words_of(t) for t in part.column("text").to_pylist()]
                scores.add(set().union(*texts))
                out = [scores.predict(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array([x for x, _ in out], pa.string()),
                     pa.array([s for _, s in out], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(tidy(predict), "doc_id long, held_out boolean, lang_pred string, score double")


def identify_languages(docs: DataFrame, **options) -> DataFrame:
    """Fit on the labelled rows outside the held-out fold and predict every document."""
    return identify(docs, fit(docs, **options), **{k: v for k, v in options.items() if k in ("id_col", "text_col")})
