"""Quality classifier (operator 7): ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold[k] - w . x): one weight vector over hashed
features of the text, shared by all grades, and ordered thresholds.  Features
are lower-cased words and the last bytes of tokens between white space (marks
that junk carries), each by presence and scaled down with the number of features,
and four properties of the whole text in classes: how many words repeat the one
before, how many are distinct, how much is in capitals, how much is marks.  Those
of few sampled texts keep weight 0.  Fitted by AdaGrad on a bounded sample of
rated texts; it gives the expected grade and the tail probability of a grade at
least `good`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydroframe.llm import textkit

U = np.uint64
BITS = 18
#: Rated texts for each grade in the sample that a model is fitted on.
SAMPLE = 2500
#: A feature of fewer sampled texts than this has no weight.
COMMON = 5
#: Upper bounds of the classes of a text's properties; each has as many buckets at the table's end.
CLASSES = np.array([0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7])
SHAPES = 4


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) of all rows, rows ascending."""
    rows = len(at) - 1
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    starts, ends = textkit.runs(textkit.ALNUM[data], at)
    words = textkit.span_hashes(data, starts, ends)
    begin, finish = textkit.runs(textkit.SPACED[data], at)
    tails = textkit.span_hashes(data, np.maximum(begin, finish - 3), finish, textkit.EXACT)
    row = np.concatenate([textkit.rows_of(starts, at), textkit.rows_of(begin, at)])
    bucket = np.concatenate([words >> U(64 - BITS + 1), (tails >> U(64 - BITS + 1)) | U(1 << (BITS - 1))]).astype(np.int64)
    bucket = np.minimum(bucket, (1 << BITS) - 1 - SHAPES * (len(CLASSES) + 1))
    key = np.unique((row << BITS) | bucket)
    row = key >> BITS
    scale = np.maximum(np.bincount(row, minlength=rows), 16) ** -0.25
    shape_row, shape = _shapes(data, at, words, starts)
    row, bucket = np.concatenate([row, shape_row]), np.concatenate([key & ((1 << BITS) - 1), shape])
    value = np.concatenate([scale[key >> BITS], np.ones(len(shape))])
    order = np.argsort(row, kind="stable")
    return row[order], bucket[order], value[order]


def _shapes(data: np.ndarray, at: np.ndarray, words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the classes of each row's properties; rows without words have none."""
    rows = len(at) - 1
    of = textkit.rows_of(starts, at)
    n = np.bincount(of, minlength=rows)
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (of[1:] == of[:-1])
    order = np.lexsort((words, of))
    fresh = np.ones(len(words), bool)
    fresh[1:] = (words[order][1:] != words[order][:-1]) | (of[order][1:] != of[order][:-1])
    each = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[at])
    letters, size = each((data >= 0x41) & (data <= 0x5A) | (data >= 0x61) & (data <= 0x7A)), np.maximum(np.diff(at), 1)
    marks = np.isin(data, np.frombuffer(b"#$%&*|!@^~<>{}", np.uint8))
    shares = [np.bincount(of, again, minlength=rows) / np.maximum(n, 1), 1 - np.bincount(of[order], fresh, minlength=rows) / np.maximum(n, 1), each((data >= 0x41) & (data <= 0x5A)) / np.maximum(letters, 1), each(marks) / size]
    some = np.flatnonzero(n)
    width = len(CLASSES) + 1
    base = (1 << BITS) - SHAPES * width
    return np.tile(some, SHAPES), np.concatenate([base + i * width + np.searchsorted(CLASSES, s[some]) for i, s in enumerate(shares)])


class Model:
    def __init__(self, weights: np.ndarray, thresholds: np.ndarray) -> None:
        self.weights, self.thresholds = weights, thresholds

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... of each score."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -500, 500)))

    def scores(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        row, bucket, value = features(data, at)
        return np.bincount(row, self.weights[bucket] * value, minlength=len(at) - 1).astype(float)


def _bags(rated: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = textkit.buffers(batch.column(2))
            for first, end, part, edges in textkit.chunks(data, at):
                row, bucket, value = features(part, edges)
                cut = np.searchsorted(row, np.arange(end - first + 1))
                bags = [(bucket[a:b].astype(np.int32).tobytes(), value[a:b].astype(np.float32).tobytes()) for a, b in zip(cut, cut[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([*batch.slice(first, end - first).columns[:2], pa.array([x for x, _ in bags], pa.binary()), pa.array([y for _, y in bags], pa.binary())], ["name", "grade", "bucket", "value"])

    return rated.mapInArrow(textkit.trimming(run), "name long, grade int, bucket binary, value binary")


def fit(bags: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, levels: int, epochs: int = 12, rate: float = 0.5, l2: float = 1e-4, seed: int = 3) -> Model:
    """AdaGrad over minibatches; thresholds stay ordered, as their steps are exponentials."""
    texts = np.bincount(np.concatenate([np.unique(b) for b, _ in bags]), minlength=1 << BITS)
    common = texts >= min(COMMON, max(1, len(bags) // 20))
    bags = [(b[common[b]], v[common[b]]) for b, v in bags]
    weights, seen = np.zeros(1 << BITS), np.full(1 << BITS, 1e-6)
    shape = np.zeros(levels - 1)  # first threshold, then logarithms of the steps
    shape_seen = np.full(levels - 1, 1e-6)
    draw, order = np.random.default_rng(seed), np.arange(len(bags))
    for _ in range(epochs):
        draw.shuffle(order)
        for i in range(0, len(order), 32):
            some = order[i : i + 32]
            sizes = np.array([len(bags[j][0]) for j in some])
            bucket, value = np.concatenate([bags[j][0] for j in some]), np.concatenate([bags[j][1] for j in some])
            of, y = np.repeat(np.arange(len(some)), sizes), grades[some]
            score = np.bincount(of, weights[bucket] * value, minlength=len(some))
            steps = np.exp(shape[1:])
            cuts = np.concatenate([[-np.inf], shape[0] + np.concatenate([[0], np.cumsum(steps)]), [np.inf]])
            high, low = (1 / (1 + np.exp(-np.clip(cuts[y + k] - score, -500, 500))) for k in (1, 0))
            p = np.maximum(high - low, 1e-9)
            dh, dl = high * (1 - high) / p, low * (1 - low) / p
            back = (dh - dl) / len(some)  # of the loss by the score
            touched, place = np.unique(bucket, return_inverse=True)
            g = np.bincount(place, value * back[of]) + l2 * weights[touched]
            seen[touched] += g * g
            weights[touched] -= rate * g / np.sqrt(seen[touched])
            of_cut = np.zeros(levels + 1)
            np.add.at(of_cut, y + 1, -dh / len(some))
            np.add.at(of_cut, y, dl / len(some))
            inner = of_cut[1:-1]
            gs = np.concatenate([[inner.sum()], steps * np.cumsum(inner[::-1])[::-1][1:]])
            shape_seen += gs * gs
            shape -= 0.1 * gs / np.sqrt(shape_seen)
    return Model(weights, shape[0] + np.concatenate([[0], np.cumsum(np.exp(shape[1:]))]))


def train(rated: DataFrame, levels: int, sample: int = SAMPLE, seed: int = 3) -> Model:
    """Fit on at most `sample` rows of each grade of rated (doc_id, grade, text), chosen by a hash of doc_id, then of the text.

    Rows with a null text or a grade that is null or not in 0 .. levels - 1 aren't
    used; rows that repeat count once.  Without rows every weight is 0 and the
    thresholds are evenly placed.
    """
    textkit.bounded_batches(rated.sparkSession)
    rows = rated.where(F.col("text").isNotNull() & F.col("grade").between(0, levels - 1)).select(F.coalesce(F.xxhash64("doc_id"), F.lit(0)).alias("name"), F.col("grade").cast("int").alias("grade"), "text")
    got = _bags(textkit.chosen(rows, "grade", sample)).toPandas().sort_values(["name", "grade", "bucket", "value"], ignore_index=True)
    if not len(got):
        return Model(np.zeros(1 << BITS), np.arange(levels - 1) - (levels - 2) / 2)
    bags = [(np.frombuffer(b, np.int32), np.frombuffer(v, np.float32).astype(float)) for b, v in zip(got["bucket"], got["value"], strict=True)]
    return fit(bags, got["grade"].to_numpy(), levels, seed=seed)


def sampled(docs: DataFrame, grades: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, grade, text) of at most `sample` graded (doc_id, grade) documents of each grade, chosen by a hash of doc_id.

    The ids are chosen before the texts are looked at, so that no texts are shuffled
    but those chosen.  Of documents that share a doc_id the least text is taken.
    """
    known = grades.join(docs.where("text is not null").select("doc_id").distinct(), "doc_id", "left_semi").where("grade is not null")
    names = known.select(F.col("grade").cast("string").alias("grp"), F.xxhash64("doc_id").alias("name"), F.col("doc_id").cast("long").alias("tie"))
    ids = textkit.least(names, sample).select(F.col("tie").alias("doc_id"), F.col("grp").cast("int").alias("grade"))  # `sample` a grade
    return docs.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text"))


def rate(docs: DataFrame, model: Model, good: int, least: float = 0.5, text: str = "text") -> DataFrame:
    """Every row with expected_grade, tail_probability of a grade of at least `good`, and selected (at least `least`).

    Null and empty texts score 0, as a text without known words.  Columns of docs
    named like the new ones are replaced.
    """
    textkit.bounded_batches(docs.sparkSession)
    names = ["expected_grade", "tail_probability", "selected"]
    keep = [c for c in docs.columns if c not in names]
    schema = docs.select(*keep).schema.add(names[0], "double").add(names[1], "double").add(names[2], "boolean")
    place = keep.index(text)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = Model(*shared.value)
        for batch in batches:
            data, at = textkit.buffers(batch.column(place))
            for first, end, part, edges in textkit.chunks(data, at):
                tails = here.tails(here.scores(part, edges))
                tail = tails[:, good - 1]
                yield pa.RecordBatch.from_arrays([*batch.slice(first, end - first).columns, pa.array(tails.sum(axis=1)), pa.array(tail), pa.array(tail >= least)], [*keep, *names])

    return docs.select(*keep).mapInArrow(textkit.trimming(run), schema)


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of labels (doc_id, quality, toxic): 0 toxic, 1 poor, 2 good; rows with a null are left out, repeats count once."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).otherwise(1)
    return labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min(grade).alias("grade"))
