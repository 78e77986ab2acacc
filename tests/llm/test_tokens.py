"""Operators 1, 2 and 6 against the tokenizer libraries."""

import hashlib
import heapq
import random
import zlib

import numpy as np
import pytest

from hydroframe.llm import bpe, idfile, unigram
from hydroframe.llm.textkit import tokenizer_path

ODD = "aB'stmdReVl \n\t\r  09éÉÄß.$<|>!́中　‘\x1c\x85İΣσ한가\x00\x7f▁"


def strings(n, seed):
    draw = random.Random(seed)
    return ["".join(draw.choice(ODD) for _ in range(draw.randint(0, 40))) for _ in range(n)] + ["", "'", "don't we'll''s", " " * 300 + "x", "ab" * 3000, "<|endoftext|>x", "\n\n a"]


ROWS = [(1, "It's one.\n\n  Two", "x"), (2, None, "x"), (3, "", None), (1, "It's one.\n\n  Two", "x"), (None, "é中", "y"), (9, "word " * 20000, "z")]


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import public_tokenizers
    import tiktoken

    ranks = bpe.load_ranks(tokenizer_path("byte_bpe_multi_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_as_the_library(tiktoken_encoding):
    codec = bpe.Codec.of(tokenizer_path("byte_bpe_multi_50k.tiktoken"))
    texts = strings(4000, 1)
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        got = np.frombuffer(ids, "<u4")
        assert got.tolist() == tiktoken_encoding.encode_ordinary(text), text
        assert codec.decode(got) == text.encode()


def test_long_and_short_merges_agree():
    merger = bpe.Codec.of(tokenizer_path("byte_bpe_multi_50k.tiktoken")).merger
    draw = random.Random(5)
    for _ in range(200):
        raw = bytes(draw.choice(b"abcthe ion") for _ in range(draw.randint(1, 60)))
        assert merger.short(raw) == merger.long(raw)


def test_scan_equals_a_walk_of_the_automaton():
    scan = bpe.Scan()
    after, _ = bpe._automaton()
    symbols = np.random.default_rng(0).integers(0, 80, 10_000)
    state, states = bpe.FRESH, []
    for s in symbols:
        states.append(state)
        state = after[s, state]
    assert scan.states(symbols).tolist() == states


def test_byte_bpe_rows(spark, tiktoken_encoding):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, ids string")
    out = bpe.digests(docs, tokenizer_path("byte_bpe_multi_50k.tiktoken")).collect()
    want = []
    for d, t, _ in ROWS:
        ids = tiktoken_encoding.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, want))
    assert bpe.digests(docs.limit(0), tokenizer_path("byte_bpe_multi_50k.tiktoken")).count() == 0
    kept = bpe.encode(docs, tokenizer_path("byte_bpe_multi_50k.tiktoken"))
    assert kept.columns == ["doc_id", "text", "ids", "n_tokens"]


def test_ids_as_the_library():
    chunks = idfile.Chunks.of(tokenizer_path("word_bpe_49k.json"))
    assert chunks.simple
    texts = strings(4000, 2)
    for text, ids in zip(texts, chunks.encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, chunks.kind).tolist() == chunks.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_code_lengths():
    draw = np.random.default_rng(4)
    for _ in range(30):
        counts = draw.integers(0, 1000, draw.integers(2, 60)) ** 2
        lengths = idfile.code_lengths(counts, 16)
        used = lengths[counts > 0].astype(int)
        if len(used) < 2:
            continue
        assert (lengths[counts == 0] == 0).all() and sum(2.0**-used) <= 1 and used.max() <= 16
        heap = counts[counts > 0].tolist()
        heapq.heapify(heap)
        cost = 0
        while len(heap) > 1:
            both = heapq.heappop(heap) + heapq.heappop(heap)
            cost += both
            heapq.heappush(heap, both)
        assert int((counts * lengths).sum()) == cost  # as good as without a limit
    fib = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233])
    assert idfile.code_lengths(fib, 5).max() == 5


def test_pack_and_unpack():
    draw = np.random.default_rng(8)
    counts = np.bincount(draw.zipf(1.3, 20_000) % 3000, minlength=3000)
    code = idfile.Code(idfile.code_lengths(counts, 16))
    for n in (0, 1, 255, 256, 257, 5000):
        ids = draw.choice(np.flatnonzero(counts), n)
        words, marks = code.pack(ids)
        assert code.unpack(words, marks, n).tolist() == ids.tolist()
    raw = idfile.to_file(code, np.array([4, 7]), np.array([2, 1]), np.flatnonzero(counts)[:3], [])
    with pytest.raises(ValueError):
        idfile.from_file(code, raw[:-4])
    with pytest.raises(ValueError):
        idfile.from_file(code, b"x" * 40)


def test_id_files(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, ids string")
    path = tokenizer_path("word_bpe_49k.json")
    files = idfile.IdFiles.write(docs, path, end_id=1)
    tokenizer = idfile.Chunks.of(path).tokenizer
    rows = sorted(((d, tokenizer.encode(t or "", add_special_tokens=False).ids + [1]) for d, t, _ in ROWS), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    want, start = [], 0
    for d, ids in rows:
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(str, map(tuple, files.checksums().collect()))) == sorted(map(str, want))
    assert {(r["start"], r["ids"]) for r in files.read().collect()} == {(s, np.array(i, "<u4").tobytes()) for (_, s, _, _), (_, i) in zip(want, rows, strict=True)}
    names = files.export(str(tmp_path / "out"))
    code = idfile.Code(np.frombuffer((tmp_path / "out/code.lengths").read_bytes(), np.uint8))
    read = [idfile.from_file(code, open(n, "rb").read())[2].tolist() for n in names]
    assert sum(read, []) == sum((i for _, i in rows), [])
    assert idfile.IdFiles.write(docs.limit(0), path).checksums().count() == 0


def test_counts_as_the_library(spark):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    counter = unigram.Counter.of(path)
    library = sentencepiece.SentencePieceProcessor(model_proto=unigram.proto(path).SerializeToString())
    for text in [*strings(4000, 3), "  a", "a  ", "\n", "a\n b", "xyz" * 500]:
        assert counter.count(text) & ((1 << unigram.SHIFT) - 1) == len(library.encode(text)), text
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, score string")
    out = unigram.counts(docs, path)
    assert out.columns == ["doc_id", "text", "n_tokens", "score"]
    assert sorted(str((r["doc_id"], r["n_tokens"])) for r in out.collect()) == sorted(str((d, len(library.encode(t or "")))) for d, t, _ in ROWS)
    assert unigram.counts(docs.limit(0), path).count() == 0
