"""Token ids and their binary files (operator 6).

Ids come from the tokenizers library.  A file holds a run of whole documents:

    magic 8 bytes | header length uint32 | JSON header | doc_id int64[] | n_tokens int64[] |
    checkpoints uint64[] | packed bits

Ids are coded by one canonical Huffman code for all files, of at most `limit`
bits a code, made by package-merge from counts over the whole corpus; code
lengths alone (one byte an id) describe it.  Every BLOCK ids the bit offset is
noted, so blocks are decoded independently: all blocks of a file step forward
together, each step one look-up of `limit` bits.  Files are rows of a table in
the shared folder: Spark's commit protocol then drops what lost tasks wrote,
and any store that Spark reads will do.  `export` copies them out as files.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from hydroframe.llm import textkit

MAGIC = b"HYIDS\x00\x01\n"
BLOCK = 256
FILE_TOKENS = 1 << 19
LIMIT = 16


# --- encoding by the tokenizers library -------------------------------------------------------------


class Pieces(dict):
    """From a word of the pre-tokenizer to the ids that the tokenizer's model gives it, packed."""

    def __init__(self, model, kind: np.dtype, most: int) -> None:
        super().__init__()
        self.model, self.kind, self.most = model, kind, most

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        out = array(self.kind.char, [t.id for t in self.model.tokenize(piece)]).tobytes()
        if len(piece) < 200:
            self[piece] = out
        return out


def _byte_points() -> dict[int, int]:
    """The code point of each byte in byte-level vocabularies: itself if it prints, else the next one from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {b: 256 + i for i, b in enumerate(other)}


BYTE_POINTS = _byte_points()


class Chunks(dict):
    """From a chunk without white space to its ids, packed.

    Chunks encode independently if the tokenizer splits at white space and drops it;
    `simple` tells whether its normaliser and pre-tokenizer are of that known form.
    A missing chunk then goes through the library's normaliser, pre-tokenizer and
    model, with the words of the model cached too; else the library encodes whole
    texts.
    """

    _made: dict[str, Chunks] = {}
    #: The form of normaliser and pre-tokenizer, and the latter's pattern for lower-case printable ASCII.
    NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ a-z0-9]+")
    #: A Latin word with a mark behind it, if any: composed letters that keep their length in lower case.
    WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")

    def __init__(self, path: str, most: int = 1_000_000) -> None:
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        split, *rest = (form.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.simple = (
            (form.get("normalizer") or {}).get("normalizers") == self.NORMALIZER
            and split == {"type": "Split", "pattern": {"Regex": self.PATTERN}, "behavior": "Removed", "invert": True}
            and [(x["type"], x["add_prefix_space"], x["use_regex"]) for x in rest] == [("ByteLevel", False, False)]
            and not form.get("post_processor")
        )
        self.added = [x["content"] for x in form.get("added_tokens", [])]
        self.simple = self.simple and all("<" in x for x in self.added)
        self.pieces = Pieces(self.tokenizer.model, self.kind, most)

    @classmethod
    def of(cls, path: str) -> Chunks:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __missing__(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8", "replace")
        if m := self.WORD.fullmatch(text):
            words = [self.bytewise(m[1].lower()), m[2]] if m[2] else [self.bytewise(m[1].lower())]
            out = b"".join(map(self.pieces.__getitem__, words))
        elif "<" in text and any(x in text for x in self.added):
            out = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        else:
            if text.isascii() and text.isprintable():
                words = self.ASCII.findall(text.lower())
            else:
                words = [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))]
            out = b"".join(map(self.pieces.__getitem__, words))
        if len(chunk) < 200:
            if len(self) >= self.most:
                self.clear()
            self[chunk] = out
        return out

    def bytewise(self, word: str) -> str:
        """The code points that stand for the bytes of a word of Latin letters in the model's vocabulary."""
        return word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_POINTS)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of UTF-8 texts."""
        if not self.simple:
            return [np.array(x.ids, self.kind).tobytes() for x in self.tokenizer.encode_batch([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]
        get = self.__getitem__
        return [b"".join(map(get, t.split())) for t in texts]  # at ASCII white space, a part of what the tokenizer splits at


def encode(docs: DataFrame, path: str, end_id: int | None = 1, text: str = "text", ids: str = "ids") -> DataFrame:
    """Every row of docs with its ids (binary, as narrow as the vocabulary allows) and the end id appended.

    Null and empty texts have the end id alone.  A column of docs named like ids is replaced.
    """
    textkit.bounded_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in (ids, text)]
    at = [*keep, text]
    schema = docs.select(*keep).schema.add(ids, "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = Chunks.of(path)
        end = b"" if end_id is None else np.array([end_id], chunks.kind).tobytes()
        for batch in batches:
            data, cuts = textkit.buffers(batch.column(len(keep)))
            for first, last, part, edges in textkit.chunks(data, cuts):
                raw, cut = part.tobytes(), edges.tolist()
                out = [x + end for x in chunks.encode([raw[a:b] for a, b in zip(cut, cut[1:], strict=False)])]
                yield pa.RecordBatch.from_arrays([*batch.slice(first, last - first).columns[: len(keep)], pa.array(out, pa.binary())], [*keep, ids])

    return docs.select(*at).mapInArrow(run, schema)


def counts(encoded: DataFrame, width: int, ids: str = "ids") -> DataFrame:
    """(id, n) over all rows; each task sends one row for each id it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            data, _ = textkit.buffers(batch.column(0))
            if len(data):
                got = np.bincount(np.frombuffer(data.tobytes(), f"<u{width}"))
                if len(got) > len(total):
                    got, total = total, got
                total[: len(got)] += got
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met], pa.int64())], ["id", "n"])

    return encoded.select(ids).mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


# --- the code ---------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code of at most `limit` bits, by package-merge; 0 where the count is 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n == 1:
        lengths[used] = 1
    if n <= 1:
        return lengths
    if n > 1 << limit:
        raise ValueError(f"{n} symbols don't fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    kept, current = [], weights
    for _ in range(limit - 1):
        # Merge the leaves with the packages of the level below; leaves come first among equals.
        packages = current[: len(current) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, packages])
        rank = np.argsort(both, kind="stable")
        kept.append(rank < n)
        current = both[rank]
    taken = 2 * n - 2
    for leaf in reversed(kept):
        leaves = int(leaf[:taken].sum())
        lengths[order[:leaves]] += 1
        taken = 2 * (taken - leaves)
    lengths[order[:taken]] += 1
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes of the lengths: shorter first, then smaller ids."""
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    size = lengths[order].astype(np.int64)
    codes = np.zeros(len(lengths), np.uint64)
    if len(order):
        most = int(size[-1])
        steps = np.left_shift(1, most - size)
        codes[order] = ((np.cumsum(steps) - steps) >> (most - size)).astype(np.uint64)
    return codes


class Code:
    def __init__(self, lengths: np.ndarray) -> None:
        self.lengths = lengths
        self.codes = canonical(lengths)
        self.both = (self.codes.astype(np.int64) << 5) | lengths
        self.bits = max(1, int(lengths.max(initial=0)))
        self.symbols = np.zeros(1 << self.bits, np.uint32)
        self.steps = np.zeros(1 << self.bits, np.uint8)
        used = np.flatnonzero(lengths)
        order = used[np.argsort(lengths[used], kind="stable")]
        span = np.left_shift(1, self.bits - lengths[order].astype(np.int64))
        filled = int(span.sum())
        self.symbols[:filled] = np.repeat(order, span)
        self.steps[:filled] = np.repeat(lengths[order], span)

    def pack(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64-bit words of the codes, first bit highest, and the bit offset of each block."""
        if not len(ids):
            return np.zeros(1, np.uint64), np.zeros(0, np.uint64)
        kind = np.int32 if len(ids) < 1 << 26 else np.int64  # of bit offsets; codes have at most 31 bits
        both = self.both[ids]
        size = (both & 31).astype(kind)
        ends = np.cumsum(size, dtype=kind)
        at = ends - size
        code, word, used = (both >> 5).astype(np.uint64), at >> 6, (at & 63) + size
        high = code << (64 - np.minimum(used, 64)).astype(np.uint64)
        split = np.flatnonzero(used > 64)
        over = (used[split] - 64).astype(np.uint64)
        high[split] = code[split] >> over
        words = np.zeros((int(ends[-1]) >> 6) + 2, np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[first]] = np.add.reduceat(high, first)  # their bits are disjoint
        words[word[split] + 1] |= code[split] << (np.uint64(64) - over)
        return words, at[::BLOCK].astype(np.uint64)

    def unpack(self, words: np.ndarray, marks: np.ndarray, n: int) -> np.ndarray:
        """The ids; all blocks advance together."""
        out = np.zeros((BLOCK, len(marks)), np.uint32)
        at, shift = marks.astype(np.uint64), np.uint64(64 - self.bits)
        words = np.concatenate([words, np.zeros(2, np.uint64)])
        last = np.uint64(len(words) - 2)
        one, six, low = np.uint64(1), np.uint64(6), np.uint64(63)
        for i in range(min(BLOCK, n)):
            word, inner = np.minimum(at >> six, last), at & low
            seen = (words[word] << inner) | ((words[word + one] >> one) >> (low - inner))
            seen >>= shift
            out[i] = self.symbols[seen]
            at += self.steps[seen]
        return out.T.reshape(-1)[:n]


# --- files ------------------------------------------------------------------------------------------


def to_file(code: Code, doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray, nulls: list[int]) -> bytes:
    words, marks = code.pack(ids)
    head = json.dumps({"docs": len(doc_ids), "tokens": len(ids), "block": BLOCK, "marks": len(marks), "words": len(words), "nulls": nulls}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, doc_ids.astype("<i8").tobytes(), sizes.astype("<i8").tobytes(), marks.astype("<u8").tobytes(), words.astype("<u8").tobytes()])


def from_file(code: Code, raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, sizes and ids of a file; raises ValueError if it is none or is cut off."""
    if raw[:8] != MAGIC:
        raise ValueError("not a file of token ids")
    (size,) = struct.unpack_from("<I", raw, 8)
    head, at = json.loads(raw[12 : 12 + size]), 12 + size
    if len(raw) != at + 8 * (2 * head["docs"] + head["marks"] + head["words"]):
        raise ValueError("the file is cut off")
    parts = []
    for kind, n in (("<i8", head["docs"]), ("<i8", head["docs"]), ("<u8", head["marks"]), ("<u8", head["words"])):
        parts.append(np.frombuffer(raw, kind, n, at))
        at += 8 * n
    doc_ids: list[int | None] = parts[0].tolist()
    for i in head["nulls"]:
        doc_ids[i] = None
    return doc_ids, parts[1], code.unpack(parts[3], parts[2], head["tokens"])


class IdFiles:
    """The files of one corpus, in ascending doc_id order.

    files: (part, shard, start, docs, tokens, file); start counts ids before the
    shard within its part; bases has the ids before each part (one number for
    each partition of the write).
    """

    def __init__(self, files: DataFrame, lengths: np.ndarray, bases: list[tuple[int, int]], width: int) -> None:
        self.files, self.lengths, self.bases, self.width = files, lengths, bases, width

    @classmethod
    def write(cls, docs: DataFrame, path: str, end_id: int | None = 1, limit: int = LIMIT) -> IdFiles:
        """Encode docs (doc_id, text) and write the files.

        Ascending doc_id, nulls first; rows with the same doc_id by their ids.
        An empty table gives no files.  Extra columns are left out.
        """
        spark = docs.sparkSession
        width = Chunks.of(path).kind.itemsize
        encoded = textkit.written(encode(docs.select("doc_id", "text"), path, end_id), "ids")
        got = np.array([(r["id"], r["n"]) for r in counts(encoded, width).collect()], np.int64).reshape(-1, 2)  # the vocabulary bounds it
        total = np.zeros(int(got[:, 0].max(initial=0)) + 1, np.int64)
        total[got[:, 0]] = got[:, 1]
        lengths = code_lengths(total, max(limit, int(len(got)).bit_length()))
        shared = spark.sparkContext.broadcast(lengths.tobytes())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            code = Code(np.frombuffer(shared.value, np.uint8))
            part, shard, start = TaskContext.get().partitionId(), 0, 0
            held: list[tuple[int | None, bytes]] = []
            size = 0

            def flush() -> pa.RecordBatch:
                sizes = np.array([len(x) // width for _, x in held], np.int64)
                ids = np.frombuffer(b"".join([x for _, x in held]), f"<u{width}")
                names = np.array([0 if d is None else d for d, _ in held], np.int64)
                raw = to_file(code, names, sizes, ids, [i for i, (d, _) in enumerate(held) if d is None])
                return pa.RecordBatch.from_pylist([{"part": part, "shard": shard, "start": start, "docs": len(held), "tokens": len(ids), "file": raw}], schema)

            for batch in batches:
                for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    held.append((doc_id, ids.as_py()))
                    size += len(held[-1][1]) // width
                    if size >= FILE_TOKENS:
                        yield flush()
                        shard, start, held, size = shard + 1, start + size, [], 0
            if held:
                yield flush()

        schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("start", pa.int64()), ("docs", pa.int64()), ("tokens", pa.int64()), ("file", pa.binary())])
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        ordered = encoded.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "ids")
        files = textkit.written(ordered.mapInArrow(run, "part int, shard int, start long, docs long, tokens long, file binary"), "idfiles")
        sums = sorted((r["part"], r["n"]) for r in files.groupBy("part").agg(F.sum("tokens").alias("n")).collect())  # one row a partition
        bases, before = [], 0
        for part, n in sums:
            bases.append((part, before))
            before += n
        return cls(files, lengths, bases, width)

    def read(self) -> DataFrame:
        """doc_id, start, n_tokens, ids (little-endian uint32) of every document, from the files."""
        return self._map(lambda raw: pa.array([x.tobytes() for x in raw], pa.binary()), "ids binary")

    def checksums(self) -> DataFrame:
        """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
        return self._map(lambda raw: pa.array([zlib.crc32(x) for x in raw], pa.int64()), "ids_crc32 long")

    def _map(self, column, field: str) -> DataFrame:
        spark = self.files.sparkSession
        shared = spark.sparkContext.broadcast(self.lengths.tobytes())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            code = Code(np.frombuffer(shared.value, np.uint8))
            for batch in batches:
                for start, base, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    doc_ids, sizes, ids = from_file(code, raw.as_py())
                    ends = np.cumsum(sizes)
                    ids = ids.astype("<u4")
                    cut = [0, *ends.tolist()]
                    made = column([ids[a:b] for a, b in zip(cut, cut[1:], strict=False)])
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(ends - sizes + start + base, pa.int64()), pa.array(sizes, pa.int64()), made], ["doc_id", "start", "n_tokens", field.split()[0]])

        bases = spark.createDataFrame([Row(part=p, base=b) for p, b in self.bases] or [], "part int, base long")
        placed = self.files.join(F.broadcast(bases), "part")  # one row for each partition of the write
        return placed.select("start", "base", "file").mapInArrow(run, f"doc_id long, start long, n_tokens long, {field}")

    def export(self, folder: str) -> list[str]:
        """Copy the files into a local folder, one after another; for single machines and tests."""
        os.makedirs(folder, exist_ok=True)
        names = []
        for row in self.files.orderBy("part", "shard").toLocalIterator():
            names.append(os.path.join(folder, f"ids-{row['part']:05d}-{row['shard']:05d}.hyids"))
            with open(names[-1], "wb") as out:
                out.write(row["file"])
        with open(os.path.join(folder, "code.lengths"), "wb") as out:
            out.write(self.lengths.tobytes())
        return names
