"""Benchmark decontamination (operator 8): prefix-filtered set join with exact verification.

A window is `size` consecutive words of an item (all its words, if it has
fewer).  A window's set is its shingles of `k` words.  All of them must be in a
document that contains the window, so the prefix that a necessary match needs is
one shingle: the rarest, by its occurrences in the whole corpus.  A document
joins its shingles with those prefixes; the place of the shingle within the
window fixes where the window would stand (positional bound), which must lie in
the document (length bound); the words there are then compared one by one, first
by hashes, then byte by byte.

Windows are a table that Spark makes, with the items of each; parts of it, of about
`most` windows, go to the driver one after another and are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydroframe.llm import textkit

U = np.uint64
#: Windows in one broadcast table (some 40 MB); more of them go in further passes.
MOST_WINDOWS = 200_000
#: Bytes as they are compared: A-Z as a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SLOTS = 1 << 20


def canonical(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words in lower case with a space after each, and where each begins (and the last ends)."""
    sizes = ends - starts
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    out = np.full(int(begin[-1]), 0x20, np.uint8)
    within = textkit.ragged(sizes)
    out[np.repeat(begin[:-1], sizes) + within] = LOWER[data[np.repeat(starts, sizes) + within]]
    return out, begin


def windows(benchmark: DataFrame, size: int) -> DataFrame:
    """(window, items): the distinct windows of all items as bytes, words in lower case with a space after each, and the item_ids that hold each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            for first, end, data, at in textkit.chunks(*textkit.buffers(batch.column(1))):
                starts, ends = textkit.runs(textkit.ALNUM[data], at)
                text, begin = canonical(data, starts, ends)
                raw, cut, item, found = text.tobytes(), begin.tolist(), [], []
                edges = np.searchsorted(starts, at).tolist()
                for i in range(first, end):
                    a, b = edges[i - first], edges[i - first + 1]
                    these = {raw[cut[j] : cut[min(j + size, b)]] for j in range(a, max(a + 1, b - size + 1) if b > a else a)}
                    found += these
                    item += [names[i]] * len(these)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(item, pa.int64())], ["window", "item"])

    rows = benchmark.where("item_id is not null").select(F.col("item_id").cast("long"), "text")
    return rows.mapInArrow(textkit.trimming(run), "window binary, item long").groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))


class Windows:
    """Distinct windows: their bytes, word hashes (padded with 0), lengths, and the items of each."""

    def __init__(self, rows: pa.Table, size: int) -> None:
        rows = rows.sort_by("window")
        data, self.at = textkit.buffers(rows["window"])
        self.raw, self.size = data.tobytes(), size
        self.items = rows["items"].to_pylist()
        starts, ends = textkit.runs(textkit.ALNUM[data], self.at)
        self.lengths = np.diff(np.searchsorted(starts, self.at))
        self.words = np.zeros((len(self.items), size), U)
        self.words[np.repeat(np.arange(len(self.items)), self.lengths), textkit.ragged(self.lengths)] = textkit.word_hashes(data, starts, ends)[0]

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, window, place) of every shingle; a window under k words has one of all its words."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.int64))]
        for n in np.unique(self.lengths).tolist():
            rows = np.flatnonzero(self.lengths == n)
            width = min(k, n)
            for place in range(n - width + 1):
                out.append((sequence(self.words[rows, place : place + width]), rows, np.full(len(rows), place)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))  # type: ignore[return-value]


def sequence(words: np.ndarray) -> np.ndarray:
    """Hash of each row of words; as textkit.sequence_hashes gives it for that many words."""
    with np.errstate(over="ignore"):
        total = np.zeros(len(words), U)
        for j in range(words.shape[1]):
            total += words[:, j] * U(pow(0xA24BAED4963EE407, j + 1, 1 << 64))
    return textkit.splitmix(total)


class Lookup:
    """Where sorted keys hold given hashes; a table of bits passes by most that are absent."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.slots = np.zeros(SLOTS, bool)
        self.slots[(keys >> U(44)).astype(np.intp)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, index of a key) of those found."""
        if not len(self.keys):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        maybe = np.flatnonzero(self.slots[(hashes >> U(44)).astype(np.intp)])
        some = hashes[maybe]
        at = np.minimum(np.searchsorted(self.keys, some), len(self.keys) - 1)
        same = self.keys[at] == some
        return maybe[same], at[same]


def _words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of all words, and their number in each row."""
    starts, ends = textkit.runs(textkit.ALNUM[data], at)
    return starts, ends, textkit.word_hashes(data, starts, ends)[0], np.diff(np.searchsorted(starts, at))


def occurrences(docs: DataFrame, keys: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """How often each shingle of the windows stands in the texts, for each shingle length."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {k: Lookup(x) for k, x in shared.value.items()}
        total = {k: np.zeros(len(x), np.int64) for k, x in shared.value.items()}
        for batch in batches:
            for _, _, data, at in textkit.chunks(*textkit.buffers(batch.column(0))):
                _, _, words, _ = _words(data, at)
                for k, lookup in tables.items():  # rows meet here; that only moves a count
                    total[k] += np.bincount(lookup.find(textkit.sequence_hashes(words, k))[1], minlength=len(total[k]))
        for k, n in total.items():
            met = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(met), k, np.int32)), pa.array(met), pa.array(n[met])], ["k", "i", "n"])

    out = {k: np.zeros(len(x), np.int64) for k, x in keys.items()}
    for r in docs.select("text").mapInArrow(textkit.trimming(run), "k int, i long, n long").groupBy("k", "i").agg(F.sum("n").alias("n")).collect():  # a row for each shingle of the part's windows
        out[r["k"]][r["i"]] = r["n"]
    return out


class Prefixes:
    """The prefix of every window: its rarest shingle, sorted by hash."""

    def __init__(self, windows: Windows, k: int, counts: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        hashes, window, place = windows.shingles(k)
        n = np.zeros(len(hashes), np.int64)
        width = np.minimum(windows.lengths[window], k)
        for w, (keys, total) in counts.items():
            of = np.flatnonzero(width == w)
            n[of] = total[np.searchsorted(keys, hashes[of])]
        order = np.lexsort((place, hashes, n, window))
        first = order[np.flatnonzero(np.diff(window[order], prepend=-1))]
        self.by: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for w in np.unique(width).tolist():
            some = first[width[first] == w]
            some = some[np.argsort(hashes[some], kind="stable")]
            self.by[w] = (hashes[some], window[some], place[some])


def _matches(words: np.ndarray, n_words: np.ndarray, prefixes: Prefixes, tables: dict[int, tuple[Lookup, np.ndarray]], windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of every occurrence of a window within one row."""
    row_end = np.cumsum(n_words)
    found_at, found_window = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for k, (lookup, first) in tables.items():
        _, window, place = prefixes.by[k]
        at, key = lookup.find(textkit.sequence_hashes(words, k))
        counts = first[key + 1] - first[key]
        at, index = np.repeat(at, counts), np.repeat(first[key], counts) + textkit.ragged(counts)
        window, start = window[index], at - place[index]
        length = windows.lengths[window]
        row = np.searchsorted(row_end, at, "right")
        inside = (start >= (row_end - n_words)[row]) & (start + length <= row_end[row])
        start, window, length = start[inside], window[inside], length[inside]
        same = np.ones(len(start), bool)
        for j in range(windows.size):
            some = same & (j < length)
            same[some] = words[start[some] + j] == windows.words[window[some], j]
        found_at.append(start[same])
        found_window.append(window[same])
    return np.concatenate(found_at), np.concatenate(found_window)


def _proved(start: np.ndarray, window: np.ndarray, windows: Windows, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether the words at each start have the window's bytes."""
    if not len(start):
        return np.empty(0, bool)
    text, begin = canonical(data, starts, ends)
    raw, low, high = text.tobytes(), begin[start].tolist(), begin[start + windows.lengths[window]].tolist()
    first, last = windows.at[window].tolist(), windows.at[window + 1].tolist()
    return np.array([raw[a:b] == windows.raw[c:d] for a, b, c, d in zip(low, high, first, last, strict=True)])


def _hits(docs: DataFrame, windows: Windows, k: int, bits: bool, text: str = "text") -> DataFrame:
    """docs without text, with n_words, n_hit, items of the windows that occur and, if asked for, a bit for each word.

    A column of another name that holds the text can stand for it; it is kept.
    """
    spark = docs.sparkSession
    hashes, window, _ = windows.shingles(k)
    width = np.minimum(windows.lengths[window], k)
    keys = {int(w): np.unique(hashes[width == w]) for w in np.unique(width)}
    counts = occurrences(docs, keys) if keys else {}
    shared = spark.sparkContext.broadcast((Prefixes(windows, k, {w: (keys[w], counts[w]) for w in keys}), windows))
    keep = [c for c in docs.columns if c != "text"]
    sent = keep if text in keep else [*keep, text]
    schema = docs.select(*keep).schema.add("n_words", "long").add("n_hit", "long").add("hit", "binary").add("items", T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes, windows = shared.value
        tables = {}
        for w, (hashes, _, _) in prefixes.by.items():
            distinct, first = np.unique(hashes, return_index=True)
            tables[w] = (Lookup(distinct), np.append(first, len(hashes)))
        for batch in batches:
            data, at = textkit.buffers(batch.column(sent.index(text)))
            for first, end, part, edges in textkit.chunks(data, at):
                starts, stops, words, n_words = _words(part, edges)
                start, window = _matches(words, n_words, prefixes, tables, windows)
                same = _proved(start, window, windows, part, starts, stops)
                start, window = start[same], window[same]
                depth = np.zeros(len(words) + 1, np.int64)
                np.add.at(depth, start, 1)
                np.add.at(depth, start + windows.lengths[window], -1)
                hit = np.cumsum(depth)[:-1] > 0
                ends = np.cumsum(n_words)
                row = np.searchsorted(ends, start, "right")
                items: list[set[int]] = [set() for _ in range(end - first)]
                pairs = np.unique(row * len(windows.items) + window) if len(row) else row
                for pair in pairs.tolist():
                    items[pair // len(windows.items)].update(windows.items[pair % len(windows.items)])
                n_hit = np.diff(np.concatenate([[0], np.cumsum(hit)])[np.concatenate([[0], ends])])
                marks = [np.packbits(hit[b - n : b]).tobytes() if bits and h else None for n, b, h in zip(n_words.tolist(), ends.tolist(), n_hit.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(first, end - first).columns[: len(keep)], pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(marks, pa.binary()), pa.array([sorted(x) for x in items], pa.list_(pa.int64()))],
                    [*keep, "n_words", "n_hit", "hit", "items"],
                )

    return docs.select(*sent).mapInArrow(textkit.trimming(run), schema)


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, k: int = 3, most: int = MOST_WINDOWS, keep_text: bool = False) -> DataFrame:
    """Every row of docs, without its text unless keep_text, with n_words, n_hit, n_items, items_sha256, items and contaminated.

    A word is hit if it stands inside any occurrence of a window.  Null and empty
    texts have no words; an item without words, or without item_id, has no
    windows; an empty benchmark hits nothing.  Items that share an item_id count
    as one.  Rows that repeat stay repeated.  Columns of docs named like new ones
    are replaced; none is lost.  About `most` windows are broadcast at once; a larger
    benchmark takes one pass for each part, merged by row.
    """
    textkit.bounded_batches(docs.sparkSession)
    made = ("n_words", "hit", "items", "n_hit", "n_items", "items_sha256", "contaminated")
    docs = docs.select(*[c for c in docs.columns if c not in made])
    text, row = textkit.fresh("text", docs.columns), textkit.fresh("row", docs.columns)
    if keep_text:
        docs = docs.withColumn(text, F.col("text"))
    tables = textkit.Tables(docs.sparkSession, "decontam")
    every = tables.write(windows(benchmark, size), "windows")
    parts = max(1, -(-every.count() // most))
    part = lambda i: Windows(every.where(F.pmod(F.xxhash64("window"), F.lit(parts)) == i).toArrow(), size)
    if parts == 1:
        found = _hits(docs, part(0), k, False, text if keep_text else "text").drop("hit")
    else:
        keyed = textkit.written(docs.withColumn(row, F.monotonically_increasing_id()), "decontam-rows")
        found = [tables.write(_hits(keyed.select(row, "text"), part(i), k, True).where(f"{i} = 0 or n_hit > 0"), f"part{i}") for i in range(parts)]
        union = found[0]
        for p in found[1:]:
            union = union.unionByName(p)
        both = union.groupBy(row).agg(F.max("n_words").alias("n_words"), F.collect_list("hit").alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
        both = textkit.written(both.select(row, "n_words", F.pandas_udf(_united, "long")("hits").alias("n_hit"), "items"), "decontam-hits")
        found = keyed.drop("text").join(both, row).drop(row)
    tables.drop()
    listed = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        *[F.col(text).alias("text") if c == text else c for c in docs.columns if c != "text"], "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ",").cast("binary"), 256).alias("items_sha256"), "items", (F.col("n_hit") > 0).alias("contaminated"),
    )


def _united(lists: pd.Series) -> pd.Series:
    """How many bits are set in any of the byte strings of each list, which have one length."""

    def count(parts: list[bytes]) -> int:
        total = 0
        for p in parts:
            total |= int.from_bytes(p, "big")
        return total.bit_count()

    return lists.map(count)
