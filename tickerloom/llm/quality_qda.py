"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

statistics() turns every text into FEATURES. Statistics of few words say little, so those of a text of n words are moved
to u = n / (n + DOUBT_WORDS) * (x - center), center being the mean over all labelled rows; fitting and scoring both see u.
fit() takes class means and covariances of u from sums that tasks add up in one pass (all labelled rows count, none is
sampled), standardises by the pooled spread, shrinks each class covariance towards the pooled one and towards a multiple
of the identity, and caches the inverse Cholesky factors. A score is the logistic of the difference of the two fitted log
densities, priors included.

Null text is empty text and is scored like any other. Label rows with a null doc_id or label are ignored; of repeated
labels of a document the largest counts. Repeated documents are scored once each. If a class has fewer than two rows,
every score is the share of label 1 (0.5 without any label). An empty table gives an empty result. Columns of docs
other than doc_id and text are not read; filtering keeps them all, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.common import written

FEATURES = (
    "log_words",
    "word_length",
    "word_length_spread",
    "distinct_words",
    "upper",
    "symbols",
    "stops",
    "shouts",
    "digits",
    "bars",
    "plain_words",
    "dup_lines",
    "line_words",
    "echoes",
)
#: Shrinkage of a class covariance towards the pooled one, then towards the identity.
TO_POOLED = 0.2
TO_IDENTITY = 0.05
#: A text of n words moves n / (n + DOUBT_WORDS) of the way from the average text.
DOUBT_WORDS = 8.0
THRESHOLD = 0.3

_ALPHA = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_SYMBOL = np.array([chr(b) in "#*$%&<>@^~={}[]\\_+/" for b in range(256)])
_STOP = np.array([chr(b) in ".,;:" for b in range(256)])
_KINDS = np.stack([_ALPHA, _UPPER, _DIGIT, _SYMBOL, _STOP]).astype(np.float64)


def text_statistics(raw: bytes) -> list[float]:
    """FEATURES of one UTF-8 text; shares are of bytes that are not white space, square roots even out their skew."""
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    alpha, upper, digit, symbol, stop = _KINDS @ counts
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=n)
    solid = lengths.sum()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    plain = sum(map(bytes.isalpha, words)) if alpha == counts[65:91].sum() + counts[97:123].sum() else sum(w.translate(None, _HIGH).isalpha() for w in words)
    return [
        float(np.log1p(n)),
        float(np.log1p(lengths.mean())),
        float(np.log1p(lengths.std())),
        float(np.log(len(set(words)) / n)),
        float(np.sqrt(upper / max(alpha, 1.0))),
        float(np.sqrt(symbol / solid)),
        float(np.sqrt(stop / solid)),
        float(np.sqrt((counts[33] + counts[63]) / solid)),
        float(np.sqrt(digit / solid)),
        float(np.sqrt(counts[124] / solid)),
        float(plain / n),
        float(np.sqrt(1.0 - len(set(lines)) / len(lines))),
        float(np.log1p(n / len(lines))),
        float(np.sqrt(sum(map(eq, words, words[1:])) / n)),
    ]


#: Bytes of characters beyond ASCII; they count as letters here.
_HIGH = bytes(range(128, 256))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and x, the array of FEATURES, for every row."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_statistics(t.as_py() or b"") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary")).mapInArrow(measure, "doc_id bigint, x array<double>")


def one_label(labels: DataFrame, label: str) -> DataFrame:
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    return known.groupBy(F.col("doc_id").alias("label_id")).agg(F.max(label).cast("int").alias("label"))


def trust(x: np.ndarray) -> np.ndarray:
    """How far each row of statistics is believed, from its words' number; a column."""
    n = np.expm1(x[:, :1])
    return n / (n + DOUBT_WORDS)


@dataclass(frozen=True)
class Model:
    prior: float
    center: np.ndarray | None = None
    scale: np.ndarray | None = None
    means: tuple[np.ndarray, np.ndarray] | None = None
    factors: tuple[np.ndarray, np.ndarray] | None = None  # inverses of the Cholesky factors
    offset: float = 0.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.center is None:
            return np.full(len(x), self.prior)
        z = trust(x) * (x - self.center) / self.scale
        far = [((z - m) @ f.T) ** 2 for m, f in zip(self.means, self.factors, strict=True)]
        gap = 0.5 * (far[0].sum(axis=1) - far[1].sum(axis=1)) + self.offset
        return 1.0 / (1.0 + np.exp(-np.clip(gap, -60, 60)))


def class_sums(x: np.ndarray) -> np.ndarray:
    """What the fit needs of a class's rows x with trusts w, end to end: their number, the sums of x, w, w^2, w x, w^2 x
    and w^2 x x'. The moments of w (x - c) follow from them for any center c."""
    w = trust(x)
    v = w * x
    return np.concatenate([[len(x)], x.sum(axis=0), [w.sum(), (w * w).sum()], v.sum(axis=0), (w * v).sum(axis=0), (v.T @ v).ravel()])


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", train: Column | None = None) -> Model:
    """The model from rows of stats that have a label and for which train (of doc_id) holds."""
    rows = stats if train is None else stats.where(train)
    rows = rows.join(one_label(labels, label), F.col("doc_id") == F.col("label_id")).select("label", "x")
    d = len(FEATURES)
    none = class_sums(np.zeros((0, d)))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {0: none.copy(), 1: none.copy()}
        for batch in batches:
            if batch.num_rows:
                y = batch.column(0).to_numpy()
                x = batch.column(1).flatten().to_numpy().reshape(-1, d)
                for c in total:
                    total[c] += class_sums(x[y == c])
        yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], ["label", "sums"])

    sums = rows.mapInArrow(add_up, "label bigint, sums array<double>").select("label", F.posexplode("sums").alias("at", "v"))
    got = {0: none.copy(), 1: none.copy()}
    for r in sums.groupBy("label", "at").agg(F.sum("v").alias("v")).collect():  # 2 * (3 + 3 * d + d * d) numbers
        got[r["label"]][r["at"]] = r["v"]
    return solve(got[0], got[1], d)


def solve(sums0: np.ndarray, sums1: np.ndarray, d: int) -> Model:
    """The model from each class's class_sums."""
    n = [float(s[0]) for s in (sums0, sums1)]
    prior = n[1] / sum(n) if sum(n) else 0.5
    if min(n) < 2:
        return Model(prior)
    center = (sums0[1 : 1 + d] + sums1[1 : 1 + d]) / sum(n)
    means, covs = [], []
    for s, k in zip((sums0, sums1), n, strict=True):
        w1, w2 = s[1 + d : 3 + d]
        wx, wwx, products = s[3 + d : 3 + 2 * d], s[3 + 2 * d : 3 + 3 * d], s[3 + 3 * d :].reshape(d, d)
        mean = (wx - w1 * center) / k
        cross = np.outer(wwx, center)
        means.append(mean)
        covs.append((products - cross - cross.T + w2 * np.outer(center, center)) / k - np.outer(mean, mean))
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / sum(n)
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-8))
    covs, pooled = [c / np.outer(scale, scale) for c in covs], pooled / np.outer(scale, scale)
    factors, half_logs = [], []
    for c in covs:
        c = (1 - TO_POOLED) * c + TO_POOLED * pooled
        c = (1 - TO_IDENTITY) * c + TO_IDENTITY * max(np.trace(c) / d, 1e-6) * np.eye(d)
        lower = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(lower))
        half_logs.append(np.log(np.diag(lower)).sum())
    offset = half_logs[0] - half_logs[1] + float(np.log(n[1] / n[0]))
    return Model(prior, center, scale, tuple(m / scale for m in means), tuple(factors), offset)


def scored(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of stats."""
    d = len(FEATURES)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, d)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x))], ["doc_id", "score"])

    return stats.mapInArrow(score, "doc_id bigint, score double")


def train_rows() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 != 0


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and score of every document; texts are read once, their statistics kept as a table."""
    stats = written(statistics(docs), "quality-statistics")
    return scored(stats, fit(stats, labels, train=train_rows()))


def kept_by_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score reaches threshold, with docs' own columns.

    The model's pass and the filter's pass both compute statistics: that is cheaper than shuffling the texts.
    """
    model = fit(statistics(docs), labels, train=train_rows())
    at = docs.columns.index("text") if "text" in docs.columns else [c.lower() for c in docs.columns].index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array([text_statistics((t.as_py() or "").encode()) for t in batch.column(at)])
                batch = batch.filter(pa.array(model.scores(x) >= threshold))
            yield batch

    return docs.mapInArrow(keep, docs.schema)
