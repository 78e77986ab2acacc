"""Token counts (operator 1): count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary's matches; dynamic
programming carries the best score and the number of pieces at each place.
Ties go as in the tokenizer library: places are left in ascending order and only
a strictly better score replaces one, so of equal scores the earliest start
stays.  A code point without a piece of its own costs the least score less 10,
and counts as its UTF-8 bytes if the vocabulary falls back to bytes.

Scores are integers: a unigram file's times SCALE, rounded; for a file whose
scores are merge ranks, -SCALE * log(2 + place among the pieces), rounded.  Sums
are then exact, and equal to the library's 32-bit floats up to 2**24, so units
that no piece crosses (the words, by the vocabulary itself) are counted once and
kept in a bounded cache.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from hydroframe.llm import textkit

SCALE = 16
MARK = "▁"
#: Fixed values of the library's model format: kinds of pieces and of models, and the penalty of unknown code points.
NORMAL, USER_DEFINED, BYTE = 1, 4, 6
UNIGRAM, RANKED = 1, 2
UNKNOWN_PENALTY = 10
#: A count in the low bits and a negated score above them, so that both add up in one sum.
SHIFT = 44


def proto(path: str):
    """The file's model as a unigram model with the integer scores."""
    from sentencepiece import sentencepiece_model_pb2 as format_

    model = format_.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    kind, place = model.trainer_spec.model_type, 0
    for piece in model.pieces:
        if piece.type == NORMAL:
            piece.score = -round(SCALE * math.log(2 + place)) if kind == RANKED else round(SCALE * piece.score)
            place += 1
    model.trainer_spec.model_type = UNIGRAM
    return model


class Counter:
    _made: dict[str, Counter] = {}

    def __init__(self, path: str, most: int = 700_000) -> None:
        import ahocorasick

        model = proto(path)
        self.bytes, self.prefix = model.trainer_spec.byte_fallback, model.normalizer_spec.add_dummy_prefix
        if model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces or not model.normalizer_spec.escape_whitespaces:
            raise ValueError("only vocabularies that leave texts as they are can be counted")
        scores = [p.score for p in model.pieces if p.type == NORMAL]
        self.unknown = int(min(scores)) - UNKNOWN_PENALTY
        if any(p.type == USER_DEFINED for p in model.pieces):
            raise ValueError("user-defined pieces aren't handled")
        self.matches = ahocorasick.Automaton()
        for p in model.pieces:
            if p.type == NORMAL:
                self.matches.add_word(p.piece, (len(p.piece), int(p.score)))
        self.matches.make_automaton()
        pieces = [p.piece for p in model.pieces if p.type == NORMAL]
        #: No piece goes on beyond a word's end, and none holds a line's end.
        self.by_word = not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        self.by_line = not any("\n" in p for p in pieces)
        self.line_end = 1 + (-self.unknown << SHIFT)
        self.marked, self.bare = Units(self, MARK, most), Units(self, "", most)

    @classmethod
    def of(cls, path: str) -> Counter:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def unit(self, text: str) -> int:
        """Count and negated score of the best path through text."""
        n, unknown = len(text), self.unknown
        best, pieces = [0] * (n + 1), [0] * (n + 1)
        end, found, start, alone = 0, False, 0, False
        score = start_found = 0
        for last, (length, gain) in self.matches.iter(text):
            last += 1
            while end < last:  # settle the places before; each may end in an unknown code point
                if end:
                    self._settle(text, end, found, alone, score, start_found, best, pieces, unknown)
                end, found, alone = end + 1, False, False
            start = last - length
            total = best[start] + gain
            if not found or total > score or (total == score and start < start_found):
                found, score, start_found = True, total, start
            alone = alone or length == 1
        while end < n + 1:
            if end:
                self._settle(text, end, found, alone, score, start_found, best, pieces, unknown)
            end, found, alone = end + 1, False, False
        return pieces[n] + (-best[n] << SHIFT)

    def _settle(self, text: str, end: int, found: bool, alone: bool, score: int, start: int, best: list[int], pieces: list[int], unknown: int) -> None:
        """Fix the best way to reach a place, once all matches that end there are known."""
        if not alone and (not found or best[end - 1] + unknown > score):
            best[end] = best[end - 1] + unknown
            pieces[end] = pieces[end - 1] + (len(text[end - 1].encode("utf-8", "replace")) if self.bytes else 1)
        else:
            best[end], pieces[end] = score, pieces[start] + 1

    def count(self, text: str) -> int:
        if not text:
            return 0
        if self.by_word and MARK not in text and text[0] != " " and "  " not in text and (self.by_line or "\n" not in text):
            if "\n" not in text:
                return sum(map(self.marked.__getitem__, text.split(" "))) if self.prefix else self.bare[text]
            lines = text.split("\n")
            total = self.line_end * (len(lines) - 1)
            for i, line in enumerate(lines):
                first, *rest = line.split(" ")
                total += (self.marked if not i and self.prefix else self.bare)[first]
                total += sum(map(self.marked.__getitem__, rest))
            return total
        whole = (MARK if self.prefix else "") + text.replace(" ", MARK)
        if not self.by_word:
            return self.bare[whole]
        return sum(map(self.bare.__getitem__, re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", whole)))


textkit.keeps("unigram", Counter._made.clear)


class Units(dict):
    """From a unit, with what stands before it, to its count and score; at most `most` are kept."""

    def __init__(self, counter: Counter, before: str, most: int) -> None:
        super().__init__()
        self.counter, self.before, self.most = counter, before, most

    def __missing__(self, unit: str) -> int:
        out = self.counter.unit(self.before + unit)
        if len(unit) < 200:
            if len(self) >= self.most:
                self.clear()
            self[unit] = out
        return out


def counts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Every row with n_tokens and score (the best path's, in 1 / SCALE).

    Null and empty texts have no tokens and score 0.  Rows that repeat stay
    repeated; columns of docs named like the new ones are replaced.
    """
    textkit.bounded_batches(docs.sparkSession)
    names = ["n_tokens", "score"]
    keep = [c for c in docs.columns if c not in names]
    schema = docs.select(*keep).schema.add(names[0], "long").add(names[1], "long")
    place = keep.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.of(path)
        for batch in batches:
            data, at = textkit.buffers(batch.column(place))
            for first, end, part, edges in textkit.chunks(data, at):
                raw, cut = part.tobytes(), edges.tolist()
                got = [counter.count(raw[a:b].decode("utf-8", "replace")) for a, b in zip(cut, cut[1:], strict=False)]
                low = (1 << SHIFT) - 1
                yield pa.RecordBatch.from_arrays([*batch.slice(first, end - first).columns, pa.array([x & low for x in got], pa.int64()), pa.array([-(x >> SHIFT) for x in got], pa.int64())], [*keep, *names])

    return docs.select(*keep).mapInArrow(textkit.trimming(run, "unigram"), schema)
