"""Byte-level BPE encoding and decoding (operator 2).

Pre-tokenisation is vectorised.  Each code point of a chunk of texts gets a
symbol (its class, whether white space ends there, and its role in an
apostrophe suffix that could stand there).  The splitting automaton has seven
states; each symbol is a function from states to states.  Functions compose
associatively, so the state before every code point comes from a blocked scan
over function numbers, whose products are looked up in a table.  No regular
expression runs.  The slices between token starts feed a pair merger with a
bounded cache; offsets of ids and bytes are kept, so decoding is a gather.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydroframe.llm import textkit

# Classes of code points.
SPACE, WHITE, LETTER, NUMBER, OTHER = range(5)
# States: what the code point before was; IN_SUFFIX within an apostrophe suffix, FRESH after its end and before a text.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, AFTER_WHITE, IN_SUFFIX = range(7)
# Roles in an apostrophe suffix that stands there if the apostrophe starts a token.
NO_ROLE, QUOTE, MIDDLE, LAST = range(4)

#: White_Space code points of Unicode that are no separators by category.
WHITE_CONTROLS = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85]


def _classes() -> np.ndarray:
    """The class of every code point, from its general category."""
    kinds = {"L": LETTER, "N": NUMBER, "Z": WHITE}
    category = unicodedata.category
    out = np.fromiter((kinds.get(category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[WHITE_CONTROLS] = WHITE
    out[0x20] = SPACE
    return out


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """next_state[symbol, state] and starts[symbol, state].

    symbol = class + 5 * (more white space follows a white code point, or the text ends there)
                   + 10 * role in an apostrophe suffix
                   + 40 * (first code point of its text).
    """
    after, starts = np.zeros((80, 7), np.uint8), np.zeros((80, 7), bool)
    for symbol in range(80):
        kind, joined, role, first = symbol % 5, symbol // 5 % 2, symbol // 10 % 4, symbol // 40
        for was in range(7):
            state = FRESH if first else was
            if kind in (SPACE, WHITE):
                # A run of white space is one token, but its last code point stands alone if text follows.
                starts[symbol, was] = not (state in (AFTER_SPACE, AFTER_WHITE) and joined)
                after[symbol, was] = AFTER_SPACE if kind == SPACE else AFTER_WHITE
            elif state == IN_SUFFIX and role in (MIDDLE, LAST):
                after[symbol, was] = IN_SUFFIX if role == MIDDLE else FRESH
            else:
                same = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS}[kind]
                starts[symbol, was] = state not in (same, AFTER_SPACE)
                after[symbol, was] = IN_SUFFIX if role == QUOTE and starts[symbol, was] else same
    return after, starts


class Scan:
    """The state before each symbol, by an associative scan over transition functions."""

    BLOCK = 64

    def __init__(self) -> None:
        after, self.starts = _automaton()
        known: dict[bytes, int] = {}
        functions: list[np.ndarray] = []

        def number(f: np.ndarray) -> int:
            key = f.tobytes()
            if key not in known:
                known[key] = len(functions)
                functions.append(f)
            return known[key]

        number(np.arange(7, dtype=np.uint8))
        self.of_symbol = np.array([number(f) for f in after], np.uint16)
        done = -1
        while done != len(functions):  # close the set under composition
            done = len(functions)
            for f in functions[:done]:
                for g in functions[:done]:
                    number(g[f])
        self.functions = np.array(functions, np.uint8)
        self.then = np.array([[known[g[f].tobytes()] for g in functions] for f in functions], np.uint16)

    def prefixes(self, f: np.ndarray) -> np.ndarray:
        """Composition of all functions before each place."""
        n, b = len(f), self.BLOCK
        if n <= b:
            out, now = np.zeros(n, np.uint16), 0
            for i in range(n):
                out[i] = now
                now = self.then[now, f[i]]
            return out
        rows = -(-n // b)
        grid = np.zeros((rows, b), np.uint16)
        grid.reshape(-1)[:n] = f
        grid = np.ascontiguousarray(grid.T)
        within = np.empty_like(grid)
        now = np.zeros(rows, np.uint16)
        flat, k = self.then.reshape(-1), len(self.functions)
        for i in range(b):
            within[i] = now
            now = flat[now.astype(np.intp) * k + grid[i]]
        before = self.prefixes(now)
        out = flat[before.astype(np.intp)[None, :] * k + within]
        return np.ascontiguousarray(out.T).reshape(-1)[:n]

    def states(self, symbols: np.ndarray) -> np.ndarray:
        return self.functions[self.prefixes(self.of_symbol[symbols]), FRESH]


class Splitter:
    """Token starts of texts that lie one after another."""

    def __init__(self) -> None:
        self.classes = _classes()
        self.scan = Scan()

    def starts(self, points: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Positions of token starts; points: code points of all texts; at: their offsets."""
        n = len(points)
        if not n:
            return np.empty(0, np.int64)
        kind = self.classes[points]
        symbols = kind.copy()
        first = at[:-1][(at[1:] > at[:-1])]
        last = at[1:][(at[1:] > at[:-1])] - 1
        white = kind <= WHITE
        joined = np.empty(n, bool)
        joined[:-1] = white[1:]
        joined[last] = True
        symbols[white & joined] += 5
        quotes = np.flatnonzero(points == 0x27)
        if len(quotes):
            room = last[np.searchsorted(last, quotes)] - quotes
            a = points[np.minimum(quotes + 1, n - 1)]
            b = points[np.minimum(quotes + 2, n - 1)]
            one = (room >= 1) & ((a == 0x73) | (a == 0x74) | (a == 0x6D) | (a == 0x64))
            two = (room >= 2) & (((a == 0x72) & (b == 0x65)) | ((a == 0x76) & (b == 0x65)) | ((a == 0x6C) & (b == 0x6C)))
            symbols[quotes[one | two]] += 10 * QUOTE
            symbols[quotes[two] + 1] += 10 * MIDDLE
            symbols[np.concatenate([quotes[one] + 1, quotes[two] + 2])] += 10 * LAST
        symbols[first] += 40
        states = self.scan.states(symbols)
        return np.flatnonzero(self.scan.starts.reshape(-1)[symbols.astype(np.intp) * 7 + states])


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Merger(dict):
    """From a slice of text to its ids as little-endian uint32 bytes; at most `most` slices are kept."""

    def __init__(self, ranks: dict[bytes, int], most: int = 300_000) -> None:
        super().__init__()
        self.ranks, self.most = ranks, most
        self.packed = {r: r.to_bytes(4, "little") for r in ranks.values()}

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode("utf-8", "surrogatepass")
        rank = self.ranks.get(raw)
        out = self.packed[rank] if rank is not None else b"".join([self.packed[self.ranks[x]] for x in (self.short(raw) if len(raw) < 200 else self.long(raw))])
        if len(raw) < 200:
            if len(self) >= self.most:
                self.clear()
            self[piece] = out
        return out

    def short(self, raw: bytes) -> list[bytes]:
        """Merge the leftmost pair of least rank, until none is left."""
        get = self.ranks.get
        parts = [raw[i : i + 1] for i in range(len(raw))]
        none = 1 << 60
        pairs = [get(raw[i : i + 2], none) for i in range(len(raw) - 1)]
        while pairs:
            least = min(pairs)
            if least == none:
                break
            i = pairs.index(least)
            joined = parts[i] + parts[i + 1]
            parts[i] = joined
            del parts[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = get(joined + parts[i + 1], none)
            if i:
                pairs[i - 1] = get(parts[i - 1] + joined, none)
        return parts

    def long(self, raw: bytes) -> list[bytes]:
        """The same merges by a heap over a linked list, for slices without a bound on length."""
        n, get = len(raw), self.ranks.get
        ends, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            if not alive[i] or after[i] >= n or ends[after[i]] != end:
                continue
            j = after[i]
            if not alive[j]:
                continue
            alive[j], ends[i], after[i] = False, end, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (r := get(raw[i : ends[after[j]]])) is not None:
                    heapq.heappush(heap, (r, i, ends[after[j]]))
            if before[i] >= 0 and (r := get(raw[before[i] : end])) is not None:
                heapq.heappush(heap, (r, before[i], end))
        return [raw[i : ends[i]] for i in range(n) if alive[i]]


class Codec:
    """Encodes texts to ids and decodes ids to bytes, by a file of ranks."""

    _made: dict[str, Codec] = {}

    def __init__(self, path: str) -> None:
        ranks = load_ranks(path)
        self.splitter, self.merger = Splitter(), Merger(ranks)
        sizes = np.zeros(max(ranks.values(), default=-1) + 1, np.int64)
        for word, rank in ranks.items():
            sizes[rank] = len(word)
        self.sizes = sizes
        self.first = np.cumsum(sizes) - sizes
        self.bytes = np.frombuffer(b"".join(sorted(ranks, key=ranks.__getitem__)), np.uint8)

    @classmethod
    def of(cls, path: str) -> Codec:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian uint32."""
        text = "".join(texts)
        at = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=at[1:])
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = self.splitter.starts(points, at)
        cut = starts.tolist()
        cut.append(len(text))
        get = self.merger.__getitem__
        found = [get(text[a:b]) for a, b in zip(cut, cut[1:], strict=False)]
        edges = np.searchsorted(starts, at).tolist()
        return [b"".join(found[a:b]) for a, b in zip(edges, edges[1:], strict=False)]

    def decode(self, ids: np.ndarray) -> bytes:
        return self.decode_all(ids, np.array([0, len(ids)]))[0].tobytes()

    def decode_all(self, ids: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that all ids stand for, by one gather, and where each text's begin and end; edges are offsets of the texts' ids."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        out = self.bytes[np.repeat(self.first[ids] - (ends - sizes), sizes) + np.arange(total)]
        return out, np.concatenate([[0], ends])[edges]


textkit.keeps("bpe", Codec._made.clear)


def _texts(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, list[str]]]:
    data, at = textkit.buffers(batch.column(batch.schema.get_field_index(column)))
    for first, end, part, edges in textkit.chunks(data, at):
        raw, cut = part.tobytes(), edges.tolist()
        yield first, end, [raw[a:b].decode("utf-8", "replace") for a, b in zip(cut, cut[1:], strict=False)]


def _decoded(codec: Codec, raw: bytes, edges: np.ndarray) -> pa.Array:
    data, at = codec.decode_all(np.frombuffer(raw, "<u4"), edges // 4)
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", n_tokens: str = "n_tokens", decoded: str | None = None) -> DataFrame:
    """Every row of docs with its ids (binary, little-endian uint32) and their number; with `decoded`, also a column of the bytes that the ids stand for.

    Null and empty texts have no ids.  Rows that repeat stay repeated.  Columns
    of docs named like the new ones are replaced.  The bytes are decoded from the ids
    alone, as `decode` does it, without another pass.
    """
    textkit.bounded_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in (ids, n_tokens, decoded)]
    schema = docs.select(*keep).schema.add(ids, "binary").add(n_tokens, "long")
    names = [*keep, ids, n_tokens]
    if decoded:
        schema, names = schema.add(decoded, "binary"), [*names, decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path)
        for batch in batches:
            for first, end, texts in _texts(batch, text):
                out = codec.encode(texts)
                sizes = np.array([len(x) for x in out])
                more = [_decoded(codec, b"".join(out), np.concatenate([[0], np.cumsum(sizes)]))] if decoded else []
                yield pa.RecordBatch.from_arrays([*batch.slice(first, end - first).columns, pa.array(out, pa.binary()), pa.array(sizes // 4, pa.int64()), *more], names)

    return docs.select(*keep).mapInArrow(textkit.trimming(run, "bpe"), schema)


def decode(encoded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Every row with the bytes that its ids stand for; a null has no ids."""
    keep = [c for c in encoded.columns if c != out]
    schema = encoded.select(*keep).schema.add(out, "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path)
        for batch in batches:
            data, at = textkit.buffers(batch.column(batch.schema.get_field_index(ids)))
            for first, end, part, edges in textkit.chunks(data, at):
                yield pa.RecordBatch.from_arrays([*batch.slice(first, end - first).columns, _decoded(codec, part.tobytes(), edges)], [*keep, out])

    return encoded.select(*keep).mapInArrow(textkit.trimming(run, "bpe"), schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document; the decoded bytes come from the ids alone."""
    made = encode(docs.select("doc_id", "text"), path, decoded="decoded")
    return made.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
