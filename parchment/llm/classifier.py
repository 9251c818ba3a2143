"""Quality classifier: random Fourier features over document statistics, ridge by partition-summed normal equations, isotonic calibration."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, slices, stash
from .quality import MARKS, STOP_WORDS

#: Cosines, and the width of the Gaussian kernel exp(-GAMMA / n * squared distance) over n standardised statistics.
FEATURES, GAMMA, RIDGE, SEED = 256, 0.25, 0.1, 11
#: Statistics count up to so many standard deviations from their mean.
REACH = 6.0
#: Labelled rows are dealt into FOLDS; each fold's rows are scored by the model of the others to calibrate on.
FOLDS = 4
#: Raw scores are counted for calibration in so many bins over LEAST..MOST, so that the driver sees no more rows than these.
BINS, LEAST, MOST = 2048, -0.5, 1.5
#: Share of the uncalibrated score in the final one, so that documents on one level of the calibration keep an order.
ORDER_SHARE = 0.01
#: A document whose score is this or more is predicted to be good.
THRESHOLD = 0.3

SYMBOLS = b"#*$%&|<>@^_{}~+="
STATISTICS = (
    "words", "word_bytes", "word_bytes_spread", "distinct_share", "distinct_power", "repeat_next_share", "top_word_share", "symbol_share", "stop_word_share",
    "dup_line_share", "words_a_line", "byte_entropy", "digit_share", "upper_share", "stops_a_word", "commas_a_word", "short_word_share",
)
_STOPS = frozenset(w.encode() for ws in STOP_WORDS.values() for w in ws)


def describe(text: str | None) -> list[float]:
    """STATISTICS of a whole text; all 0 where it has no word."""
    data = (text or "").encode("utf-8", "replace")
    words = [w for w in (w.strip(MARKS.encode()).lower() or w for w in data.split()) if w]
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    counts = Counter(words)
    sizes = np.fromiter(map(len, words), np.int64, n)
    by_byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = by_byte[by_byte > 0] / len(data)
    lines = [x for x in data.split(b"\n") if x.strip()]
    return [
        float(np.log1p(n)),
        float(sizes.mean()),
        float(sizes.std()),
        len(counts) / n,
        float(np.log(len(counts)) / np.log(n + 1)),
        sum(map(bytes.__eq__, words, words[1:])) / n,
        max(counts.values()) / n,
        int(by_byte[list(SYMBOLS)].sum()) / len(data),
        sum(counts[w] for w in _STOPS & counts.keys()) / n,
        (len(lines) - len(set(lines))) / len(lines),
        float(np.log1p(n / len(lines))),
        float(-(share * np.log2(share)).sum()),
        int(by_byte[48:58].sum()) / len(data),
        int(by_byte[65:91].sum()) / len(data),
        int(by_byte[46]) / n,
        int(by_byte[44]) / n,
        float((sizes <= 3).mean()),
    ]


def statistics(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, stats array<double>) of every row: STATISTICS of its whole text. Null, empty and blank texts have zeros; other columns are not read."""
    kind = docs.schema[id].dataType.simpleString()

    def run(batches):
        for part in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part["id"], pa.array([describe(t) for t in part["text"].to_pylist()], pa.list_(pa.float64()))], ["id", "stats"])

    return in_arrow(docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")), run, f"id {kind}, stats array<double>")


@dataclass(frozen=True)
class Model:
    """Mean and spread of the statistics, one column of ridge weights for each fold left out and a last one for none, levels of the calibration."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    at: np.ndarray
    level: np.ndarray


def cosines(stats: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Random Fourier features of rows of statistics, and a last one that is always 1."""
    rng = np.random.default_rng(SEED)
    waves = rng.normal(size=(stats.shape[1], FEATURES)) * np.sqrt(2 * GAMMA / stats.shape[1])
    phase = rng.uniform(0, 2 * np.pi, FEATURES)
    z = np.clip((stats - mean) / spread, -REACH, REACH)
    return np.hstack((np.sqrt(2 / FEATURES) * np.cos(z @ waves + phase), np.ones((len(z), 1))))


def _matrix(lists) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), len(STATISTICS))


def _normal_equations(rows: DataFrame, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """FOLDS matrices [Z'Z | Z'y]: each task sums those of its rows, the sums are dealt out by matrix row and added up."""
    size, schema = FEATURES + 1, "fold int, row int, sums array<double>"

    def batch(found: dict):
        keys = list(found)
        columns = [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array(list(found.values()), pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays(columns, ["fold", "row", "sums"])

    def add(batches):
        sums = np.zeros((FOLDS, size, size + 1))
        for b in batches:
            folds, label = b["fold"].to_numpy(), b["label"].to_numpy().astype(float)
            z = cosines(_matrix(b["stats"]), mean, spread)
            for f in np.unique(folds):
                on = folds == f
                sums[f] += z[on].T @ np.hstack((z[on], label[on, None]))
        if sums.any():
            yield batch({(f, i): sums[f, i] for f in range(FOLDS) for i in range(size)})

    def merge(batches):
        sums: dict = {}
        for b in batches:
            values = b["sums"].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, size + 1)
            for key, v in zip(zip(b["fold"].to_pylist(), b["row"].to_pylist(), strict=True), values, strict=True):
                sums[key] = sums[key] + v if key in sums else v.copy()
        if sums:
            yield batch(sums)

    out = np.zeros((FOLDS, size, size + 1))
    for fold, row, sums in in_arrow(in_arrow(rows, add, schema).repartition("fold", "row"), merge, schema).toLocalIterator():
        out[fold, row] = sums
    return out


def isotonic(at: np.ndarray, good: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and levels of the non-decreasing fit of good / n by pooling adjacent violators; `at` rises. Between places the fit is linear."""
    blocks: list[list[float]] = []
    for x, g, m in zip(at, good, n, strict=True):
        blocks.append([x * m, float(g), float(m)])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def train(rows: DataFrame) -> Model | None:
    """A model of rows (stats, label 0 or 1, key); None without such rows.

    Rows of one key are in one fold. All rows count, each as often as it is there; rows with another label or a null go.
    To the driver come the moments, FOLDS matrices of FEATURES squared and BINS counts, however many rows there are.
    """
    rows = stash(rows.filter("stats is not null and label in (0, 1)").select("stats", F.col("label").cast("int").alias("label"), F.pmod(F.xxhash64("key"), F.lit(FOLDS)).cast("int").alias("fold")))
    n = len(STATISTICS)
    moments = rows.agg(F.count(F.lit(1)), *[F.avg(F.col("stats")[i]) for i in range(n)], *[F.stddev_pop(F.col("stats")[i]) for i in range(n)]).first()
    if not moments[0]:
        return None
    mean, spread = np.array(moments[1 : n + 1]), np.array(moments[n + 1 :])
    spread = np.where(spread > 1e-9, spread, 1.0)
    sums = _normal_equations(rows, mean, spread)
    solve = lambda s: np.linalg.solve(s[:, :-1] + RIDGE * np.eye(FEATURES + 1), s[:, -1])
    weights = np.stack([*[solve(sums.sum(0) - sums[f]) for f in range(FOLDS)], solve(sums.sum(0))], 1)

    def bins(batches):
        for b in batches:
            raw = (cosines(_matrix(b["stats"]), mean, spread) @ weights)[np.arange(b.num_rows), b["fold"].to_numpy()]
            place = np.clip(np.floor((raw - LEAST) / (MOST - LEAST) * BINS), 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(place), b["label"].cast(pa.int64())], ["bin", "label"])

    counted = sorted(tuple(r) for r in in_arrow(rows, bins, "bin int, label long").groupBy("bin").agg(F.sum("label"), F.count(F.lit(1))).collect())
    place, good, count = np.array(counted).T
    return Model(mean, spread, weights, *isotonic(LEAST + (place + 0.5) * (MOST - LEAST) / BINS, good, count))


def apply(stats: np.ndarray, model: Model | None) -> np.ndarray:
    """Scores from 0 to 1 of rows of statistics; 0.5 without a model."""
    if model is None:
        return np.full(len(stats), 0.5)
    raw = cosines(stats, model.mean, model.spread) @ model.weights[:, -1]
    order = np.clip((raw - LEAST) / (MOST - LEAST), 0, 1)
    return (1 - ORDER_SHARE) * np.interp(raw, model.at, model.level) + ORDER_SHARE * order


def score(rows: DataFrame, model: Model | None) -> DataFrame:
    """(id, stats, score, predicted) of rows (id, stats); predicted is 1 where the score is THRESHOLD or more."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            found = apply(_matrix(b["stats"]), model)
            yield pa.RecordBatch.from_arrays([b["id"], b["stats"], pa.array(found), pa.array((found >= THRESHOLD).astype(np.int32))], ["id", "stats", "score", "predicted"])

    return in_arrow(rows.select("id", "stats"), run, f"id {kind}, stats array<double>, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, learn: Column, id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """(id, stats, score, predicted) of every document, learned from the labelled ones for whose id `learn`, an expression on `id`, holds.

    Texts are read once: their statistics, a few numbers a document, are written and serve both the fit and the scores.
    Null, empty and blank texts have zeros as statistics and get the score of those. Equal texts get equal scores. A document
    with several labels counts once for each; a label other than 0 and 1, of an absent or a null id, counts for none.
    A null id is scored, never learned from. Without labels all scores are 0.5; with one class alone that class is certain.
    Very long texts count as a whole; an empty table gives an empty one; further columns are not read, whatever their names.
    """
    stats = stash(statistics(docs, id, text))
    known = labels.select(F.col(id).alias("key"), F.col(label).alias("label")).filter("key is not null and label in (0, 1)")
    rows = stats.filter(F.coalesce(learn, F.lit(False))).join(known, F.col("id") == F.col("key")).select("stats", "label", "key")
    return score(stats, train(rows))
