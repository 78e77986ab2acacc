"""Language identification (operator 9): averaged hashed subword embeddings with a linear softmax.

A text's subwords are the byte n-grams of its words (ASCII letters and bytes
from 0x80, A-Z lower-cased, with a mark at either end) and the words themselves,
hashed into buckets.  A text is the mean of their embeddings; a linear layer and
a softmax give the language.  Training is stochastic gradient descent in numpy
on the driver, over a bounded sample of texts with a language.  A temperature,
fitted on texts kept apart, calibrates the probabilities, and the least
probability that a prediction must have is part of the model (rejection).

As the mean and the layer are linear, a bucket's share of every class score is
computed once; prediction sums these shares over the distinct words of a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydroframe.llm import textkit

U = np.uint64
BITS, DIM = 16, 12
NGRAMS = (2, 3, 4)
#: Words are runs of ASCII letters and bytes from 0x80.
WORDS = textkit.class_table([(0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])
#: Texts for each language in the sample that a model is fitted on.
SAMPLE = 500
UNKNOWN = "und"


class Subwords:
    """Distinct words of a chunk of texts, their buckets, and where the words stand."""

    def __init__(self, data: np.ndarray, at: np.ndarray) -> None:
        starts, ends = textkit.runs(WORDS[data], at)
        self.per_row = np.diff(np.searchsorted(starts, at))
        hashes = textkit.span_hashes(data, starts, ends) if len(data) else np.empty(0, U)
        distinct, first, self.word = np.unique(hashes, return_index=True, return_inverse=True)
        starts, ends = starts[first], ends[first]
        sizes = ends - starts + 2
        self.starts, self.ends, self.data = starts, ends, data
        cut = np.cumsum(sizes)
        padded = np.full(int(cut[-1]) if len(cut) else 0, 0x3E, np.uint8)
        begin = cut - sizes
        inner = textkit.ragged(sizes - 2)
        padded[np.repeat(begin + 1, sizes - 2) + inner] = data[np.repeat(starts, sizes - 2) + inner]
        padded[begin] = 0x3C
        values = textkit.FOLDED[padded]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        buckets, owners = [distinct >> U(64 - BITS)], [np.arange(len(sizes))]
        for n in NGRAMS:
            grams = textkit.sequence_hashes(values, n)
            inside = owner[: len(grams)] == owner[n - 1 : n - 1 + len(grams)]
            buckets.append((grams[inside] + U(n)) >> U(64 - BITS))
            owners.append(owner[: len(grams)][inside])
        self.bucket, self.owner = np.concatenate(buckets).astype(np.int64), np.concatenate(owners)
        self.n = np.bincount(self.owner, minlength=len(sizes))
        self.listed: np.ndarray | None = None  # buckets by word, when bags are asked for

    def sums(self, table: np.ndarray) -> np.ndarray:
        """Of every row: the sum of table over its subwords, and their number in the last column."""
        wide = np.zeros((len(self.n), table.shape[1] + 1))
        for c in range(table.shape[1]):
            wide[:, c] = np.bincount(self.owner, table[self.bucket, c], minlength=len(self.n))
        wide[:, -1] = self.n
        total = np.zeros((len(self.word) + 1, wide.shape[1]))
        np.cumsum(wide[self.word], axis=0, out=total[1:])
        ends = np.cumsum(self.per_row)
        return total[ends] - total[ends - self.per_row]

    def bag(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of a run of words, with their shares."""
        if self.listed is None:
            self.listed = self.bucket[np.argsort(self.owner, kind="stable")]
            self.begin = np.cumsum(self.n) - self.n
        some = self.word[words]
        place = np.repeat(self.begin[some], self.n[some]) + textkit.ragged(self.n[some])
        bucket, n = np.unique(self.listed[place], return_counts=True)
        return bucket, n / max(1, n.sum())


def has_letter(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each row has a letter; only rows without an ASCII letter are decoded."""
    ascii_letter = np.zeros(len(data) + 1, np.int64)
    folded = data | 0x20
    np.cumsum((folded >= 0x61) & (folded <= 0x7A) & (data < 0x80), out=ascii_letter[1:])
    out = ascii_letter[at[1:]] > ascii_letter[at[:-1]]
    for i in np.flatnonzero(~out).tolist():
        text = data[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace")
        if not text.isascii():
            out[i] = any(map(str.isalpha, text))  # the categories L* of Unicode
    return out


class Model:
    def __init__(self, languages: list[str], embedding: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float, least: float) -> None:
        self.languages, self.embedding, self.weights, self.bias = languages, embedding, weights, bias
        self.temperature, self.least = temperature, least

    def share(self) -> np.ndarray:
        return self.embedding @ self.weights

    def predict(self, data: np.ndarray, at: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class, probability, accepted) of each row; class -1 without letters."""
        total = Subwords(data, at).sums(share)
        logits = total[:, :-1] / np.maximum(total[:, -1:], 1) + self.bias
        p = _softmax(logits / self.temperature)
        found = p.argmax(axis=1) if len(self.languages) else np.full(len(p), -1)
        score = p.max(axis=1, initial=0.0)
        known = has_letter(data, at) & (len(self.languages) > 0)
        return np.where(known, found, -1), np.where(known, score, 0.0), known & (score >= self.least)


def _softmax(x: np.ndarray) -> np.ndarray:
    if not x.shape[1]:
        return x
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _bags(docs: DataFrame, seed: int) -> DataFrame:
    """(name, lang, part, bucket, share): the whole text, and two runs of a few words each, drawn at random."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = textkit.buffers(batch.column(2))
            names, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = []
            for first, end, part, edges in textkit.chunks(data, at):
                sub = Subwords(part, edges)
                ends = np.cumsum(sub.per_row)
                for i in range(end - first):
                    n = int(sub.per_row[i])
                    if not n:
                        continue
                    draw = np.random.default_rng([seed, names[first + i] & 0x7FFFFFFF])
                    low = int(ends[i]) - n
                    spans = [(low, low + n)]
                    for _ in range(2):
                        size = min(n, 1 + int(draw.geometric(0.2)))
                        start = low + int(draw.integers(0, n - size + 1))
                        spans.append((start, start + size))
                    for k, (a, b) in enumerate(spans):
                        bucket, share = sub.bag(np.arange(a, b))
                        out.append((names[first + i], langs[first + i], k, bucket.astype(np.int32).tobytes(), share.astype(np.float32).tobytes()))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["name", "lang", "part", "bucket", "share"])

    return docs.mapInArrow(textkit.trimming(run), "name long, lang string, part int, bucket binary, share binary")


def _step(model: Model, rows: list, labels: np.ndarray, rate: float) -> None:
    sizes = np.array([len(b) for b, _ in rows])
    bucket, share = np.concatenate([b for b, _ in rows]), np.concatenate([s for _, s in rows])
    hidden = np.add.reduceat(model.embedding[bucket] * share[:, None], np.cumsum(sizes) - sizes, axis=0)
    error = _softmax(hidden @ model.weights + model.bias)
    error[np.arange(len(rows)), labels] -= 1
    back = error @ model.weights.T
    model.weights -= rate * hidden.T @ error / len(rows)
    model.bias -= rate * error.mean(axis=0)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    change = (share[:, None] * np.repeat(back, sizes, axis=0))[order]
    model.embedding[bucket[first]] -= rate * np.add.reduceat(change, first, axis=0)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE, epochs: int = 6, rate: float = 2.0, seed: int = 7, least: float = 0.5) -> Model:
    """Fit a model on at most `sample` texts of each language, chosen by a hash of key, then of the text, among all rows that have one.

    Rows with a null text or language aren't used; rows that repeat count once.
    Without any row the model knows no language and every prediction is `und`.
    """
    textkit.bounded_batches(docs.sparkSession)
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.coalesce(F.xxhash64(F.col(key)), F.lit(0)).alias("name"), F.col(text).alias("text"))
    got = _bags(textkit.chosen(rows, "lang", sample), seed).toPandas().sort_values(["name", "lang", "part", "bucket", "share"], ignore_index=True)
    languages = sorted(set(got["lang"]))
    if not languages:
        return Model([], np.zeros((1 << BITS, DIM)), np.zeros((DIM, 0)), np.zeros(0), 1.0, least)
    label = got["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy()
    bags = [(np.frombuffer(b, np.int32), np.frombuffer(s, np.float32).astype(np.float64)) for b, s in zip(got["bucket"], got["share"], strict=True)]
    apart = (got["name"].to_numpy() & 7) == 0
    draw = np.random.default_rng(seed)
    model = Model(languages, draw.normal(0, 0.1, (1 << BITS, DIM)), draw.normal(0, 0.1, (DIM, len(languages))), np.zeros(len(languages)), 1.0, least)
    use = np.flatnonzero(~apart) if (~apart).any() else np.arange(len(bags))
    for epoch in range(epochs):
        draw.shuffle(use)
        for i in range(0, len(use), 16):
            some = use[i : i + 16]
            _step(model, [bags[j] for j in some], label[some], rate * (1 - epoch / epochs) * 4)
    held = np.flatnonzero(apart)
    if len(held):
        logits = np.array([(model.embedding[b] * s[:, None]).sum(axis=0) @ model.weights + model.bias for b, s in (bags[j] for j in held)])
        grid = np.geomspace(0.1, 10, 41)
        loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(held)), label[held]], 1e-12)).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    del got, bags
    textkit.trim()  # the driver stays beside what follows
    return model


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Every row with lang_pred, score (0 to 1) and accepted.

    Null, empty and letterless texts get `und`, score 0 and aren't accepted; nor are
    texts whose score is under the model's least.  Only the text is looked at.
    Columns of docs named like the new ones are replaced.
    """
    textkit.bounded_batches(docs.sparkSession)
    names = ["lang_pred", "score", "accepted"]
    keep = [c for c in docs.columns if c not in names]
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("accepted", "boolean")
    place = keep.index(text)
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.share(), model.bias, model.temperature, model.least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, share, bias, temperature, least = shared.value
        here = Model(languages, np.empty(0), np.empty(0), bias, temperature, least)
        said = np.array([*languages, UNKNOWN], object)
        for batch in batches:
            data, at = textkit.buffers(batch.column(place))
            for first, end, part, edges in textkit.chunks(data, at):
                found, score, accepted = here.predict(part, edges, share)
                yield pa.RecordBatch.from_arrays([*batch.slice(first, end - first).columns, pa.array(said[found], pa.string()), pa.array(score), pa.array(accepted)], [*keep, *names])

    return docs.select(*keep).mapInArrow(textkit.trimming(run), schema)


def held_out(key: str = "doc_id"):
    """A third of the rows, by a checksum of the key's digits."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))
