"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

Every text gets a score, null and empty ones too (their statistics are all zero). Labels that are
null, or neither 0 nor 1, teach nothing; a document labelled twice counts twice. Without any usable
label every score is 0.5. Repeated rows get equal scores. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stringloom.llm.common import arrow_rows, row_key, stage, without

FEATURES = (
    "size", "word_length", "upper", "digits", "symbols", "symbol_pairs", "pipes", "non_ascii", "spaces",
    "line_words", "distinct_words", "repeats", "ends", "entropy",
)
_WORD, _UPPER, _DIGIT, _SPACE, _HIGH, _SYMBOL = range(6)
_KINDS = np.zeros((256, 6), np.float64)
for _code in range(256):
    _text = chr(_code)
    _KINDS[_code, _HIGH if _code > 127 else _DIGIT if _text.isdigit() else _UPPER if _text.isupper()
           else _WORD if _text.islower() else _SPACE if _code in (32, 9, 10, 11, 12, 13) else _SYMBOL] = 1
_IS_SYMBOL = _KINDS[:, _SYMBOL] > 0


def statistics(text: bytes | None) -> list[float]:
    """The numbers of ``FEATURES`` for one text, each of them between 0 and about 1."""
    if not text:
        return [0.0] * len(FEATURES)
    codes = np.frombuffer(text, np.uint8)
    counts = np.bincount(codes, minlength=256)
    kinds = counts @ _KINDS
    n, words = len(codes), text.split()
    n_words, lines = max(1, len(words)), text.count(b"\n") + 1
    symbol = _IS_SYMBOL[codes]
    share = counts[counts > 0] / n
    letters = max(1.0, kinds[_WORD] + kinds[_UPPER] + kinds[_HIGH])
    return [
        np.log1p(n) / 12, min(1.0, (n - kinds[_SPACE]) / n_words / 20), kinds[_UPPER] / letters, kinds[_DIGIT] / n,
        np.sqrt(kinds[_SYMBOL] / n), np.sqrt(np.count_nonzero(symbol[1:] & symbol[:-1]) / n),
        np.sqrt(counts[124] / n), kinds[_HIGH] / n, min(1.0, 2 * kinds[_SPACE] / n),
        np.log1p(n_words / lines) / 8, len(set(words)) / n_words, np.sqrt(sum(map(eq, words, words[1:])) / n_words),
        sum(w[-1] in b".!?:;" for w in words) / n_words, float(-(share * np.log2(share)).sum()) / 8,
    ]


def text_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, key, key2, features``, one row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in arrow_rows(batches, "text"):
            rows = pa.array([statistics(t) for t in texts], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], rows], ["doc_id", "key", "key2", "features"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), *row_key(doc_id, text), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, key bigint, key2 bigint, features array<double>")


@dataclass(frozen=True)
class QualityModel:
    """Everything a task needs to score: a few hundred numbers, whatever the corpus."""

    mean: np.ndarray = field(default_factory=lambda: np.zeros(len(FEATURES)))
    scale: np.ndarray = field(default_factory=lambda: np.ones(len(FEATURES)))
    waves: np.ndarray = field(default_factory=lambda: np.zeros((len(FEATURES), 1)))
    shift: np.ndarray = field(default_factory=lambda: np.zeros(1))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(2))
    steps: tuple[np.ndarray, np.ndarray] = (np.array([0.0]), np.array([0.5]))

    def lift(self, features: np.ndarray) -> np.ndarray:
        """Random Fourier features, with a last column of ones."""
        x = np.clip((features - self.mean) / self.scale, -6, 6)
        waves = np.sqrt(2 / len(self.shift)) * np.cos(x @ self.waves + self.shift)
        return np.hstack([waves, np.ones((len(x), 1))])

    def raw(self, features: np.ndarray) -> np.ndarray:
        return self.lift(features) @ self.weights

    def score(self, features: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(features), *self.steps)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("features"))
    return np.asarray(column.flatten(), np.float64).reshape(len(column), len(FEATURES))


def fit(
    rows: DataFrame, waves: int = 256, width: float = 3.0, ridge: float = 1e-2, seed: int = 11, bins: int = 2048
) -> QualityModel:
    """Fit on ``rows(features, label, fold)``: fold 0 calibrates, the others give the ridge weights.

    The normal equations are summed per partition, cell by cell, so the driver gets
    ``(waves + 2) ** 2`` numbers at most; the calibration gets two numbers for each of ``bins`` bins.
    """
    train = rows.where("fold != 0")
    moments = train.agg(
        F.count(F.lit(1)),
        *[F.avg(F.col("features")[i]) for i in range(len(FEATURES))],
        *[F.stddev_pop(F.col("features")[i]) for i in range(len(FEATURES))]).first()
    if not moments[0]:
        return QualityModel()
    mean, scale = np.array(moments[1 : len(FEATURES) + 1]), np.array(moments[len(FEATURES) + 1 :])
    draw = np.random.default_rng(seed)
    base = QualityModel(
        mean, np.maximum(scale, 1e-3), draw.normal(size=(len(FEATURES), waves)) / width,
        draw.uniform(0, 2 * np.pi, waves), np.zeros(waves + 1))
    size = waves + 2

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            z = np.hstack([base.lift(_matrix(batch)), batch.column(1).to_numpy()[:, None]])
            total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size * size)), pa.array(total.ravel())], ["cell", "value"])

    cells = train.select("features", F.col("label").cast("double").alias("label")).mapInArrow(
        products, "cell bigint, value double").groupBy("cell").agg(F.sum("value").alias("value")).toPandas()
    gram = np.zeros(size * size)
    gram[cells["cell"]] = cells["value"]
    gram = gram.reshape(size, size)
    penalty = np.eye(size - 1) * ridge * moments[0] / waves
    penalty[-1, -1] = 0
    weights = np.linalg.solve(gram[:-1, :-1] + penalty, gram[:-1, -1])
    model = QualityModel(base.mean, base.scale, base.waves, base.shift, weights)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bin_ = np.clip(np.round((model.raw(_matrix(batch)) + 1) / 3 * bins), 0, bins).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bin_), batch.column(1)], ["bin", "label"])

    table = rows.where("fold = 0").select("features", F.col("label").cast("double").alias("label")).mapInArrow(
        binned, "bin bigint, label double").groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("ones")).orderBy("bin").toPandas()
    if len(table):
        at = table["bin"].to_numpy() * 3 / bins - 1
        steps = isotonic(at, table["ones"].to_numpy(), table["n"].to_numpy())
    else:
        steps = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    return QualityModel(base.mean, base.scale, base.waves, base.shift, weights, steps)


def isotonic(at: np.ndarray, ones: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising shares by pooling neighbours that fall; each pool stands at its mean place."""
    pools: list[list[float]] = []
    for x, k, m in zip(at, ones, n, strict=True):
        pools.append([x * m, float(k), float(m)])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    table = np.array(pools)
    return table[:, 0] / table[:, 2], table[:, 1] / table[:, 2]


def score_texts(statistics_of: DataFrame, model: QualityModel) -> DataFrame:
    """``doc_id, key, key2, score`` from ``doc_id, key, key2, features``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array(model.score(_matrix(batch)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], scores], ["doc_id", "key", "key2", "score"])

    kind = statistics_of.schema["doc_id"].dataType.simpleString()
    return statistics_of.select("doc_id", "key", "key2", "features").mapInArrow(
        run, f"doc_id {kind}, key bigint, key2 bigint, score double")


def fold_of(doc_id: str = "doc_id") -> F.Column:
    """crc32 of the id as text, modulo 5; a null id counts as fold 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5, F.lit(1))


def classify(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.3
) -> DataFrame:
    """``doc_id, held_out, score, predicted``. Fold 0 is held out, fold 1 calibrates, the rest fits."""
    return _judged(docs, labels, doc_id, text, threshold).drop("key", "key2")


def _judged(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, threshold: float) -> DataFrame:
    """The columns of :func:`classify`, with ``key, key2`` of the row."""
    stats = stage(text_statistics(docs, doc_id, text), "statistics")
    known = labels.where("quality in (0, 1)").select(F.col("doc_id").alias("_id"), F.col("quality").alias("label"))
    fold = fold_of()
    rows = stats.where(fold != 0).join(known, F.col("doc_id") == F.col("_id")).select(
        "features", "label", (fold - 1).alias("fold"))
    model = fit(stage(rows, "labelled"))
    return score_texts(stats, model).select(
        "key", "key2", "doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.3
) -> DataFrame:
    """The rows of ``docs`` that :func:`classify` predicts to be good, each judged by its own text."""
    return without(docs, _judged(docs, labels, doc_id, text, threshold).where("predicted = 0"), row_key(doc_id, text))
