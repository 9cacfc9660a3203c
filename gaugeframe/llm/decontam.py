"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared as lower-case words and numbers with one space between them. An occurrence of an item may differ in
``k`` edits, or in ``WORDS`` whole words of any length put in, left out or exchanged. ``k`` is what two words come to even in short
items, and the ``error_rate`` share of long ones. Cut into ``k + 3`` pieces, three must occur unchanged on about the same diagonal; cut
into ``WORDS + 1`` runs of words, one must. An Aho-Corasick automaton finds all exact hits of both in one pass, and Myers'
bit-parallel distance, over characters and over words, decides.

The items are the query set: they go to the tasks in blocks of at most ``block_chars`` characters, one pass over the
documents per block, so a benchmark of any size works in bounded memory. Documents are never shuffled.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..staging import stage
from .common import drop_ids, thrifty


_WORDS = re.compile(r"[^\W_]+")


def normalise(text: str | None) -> str:
    """Words and numbers in lower case with one space between them: marks, spacing and letter case are no edits."""
    return " ".join(_WORDS.findall((text or "").lower()))


REWORDED = 12  # edits that two exchanged words of the usual length come to
WORDS = 2  # words that may differ whatever their length
LONGEST = 64  # characters by which words put in may move an occurrence


def edit_budget(chars: int, error_rate: float, piece_chars: int) -> int:
    """Edits an occurrence of an item of ``chars`` characters may have: a fifth of what it has above ``piece_chars`` up to
    ``REWORDED``, and the ``error_rate`` share beyond. Items of up to ``piece_chars`` must occur exactly."""
    return max(int(error_rate * chars), min(REWORDED, (chars - piece_chars) // 5)) if chars > piece_chars else 0


def word_budget(words: int) -> int:
    """Whole words that may differ: one in four at most."""
    return min(WORDS, words // 4)


class Myers:
    """Bit-parallel edit distance of one pattern, one machine step per text character."""

    def __init__(self, pattern: Sequence[str]):
        self.m = len(pattern)
        self.at: dict[str, int] = defaultdict(int)  # a character, or a word where the pattern is a list of words
        for k, c in enumerate(pattern):
            self.at[c] |= 1 << k

    def columns(self, text: Sequence[str], anchored: bool = False):
        """After each text character: the distance of the pattern to the best text ending there (``anchored``: to all of it)."""
        full, top = (1 << self.m) - 1, 1 << (self.m - 1)
        up, down, score, at, carry = full, 0, self.m, self.at.get, int(anchored)
        for c in text:
            eq = at(c, 0)
            v = eq | down
            h = (((eq & up) + up) ^ up) | eq
            more = down | (full & ~(h | up))
            less = up & h
            if more & top:
                score += 1
            elif less & top:
                score -= 1
            more = ((more << 1) | carry) & full
            less = (less << 1) & full
            up = less | (full & ~(v | more))
            down = more & v
            yield score


class Matcher:
    """All items of a block, ready to be found in texts."""

    def __init__(self, items: list[tuple[object, str]], error_rate: float, piece_chars: int):
        import ahocorasick

        self.items = [(key, text, edit_budget(len(text), error_rate, piece_chars)) for key, text in items]
        self.forward: dict[int, Myers] = {}
        self.backward: dict[int, Myers] = {}
        self.wordly: dict[int, Myers] = {}
        self.words = [text.split(" ") for _, text, _ in self.items]
        self.differ = [word_budget(len(words)) if k else 0 for words, (*_, k) in zip(self.words, self.items)]
        self.need = []
        pieces = defaultdict(list)  # (item, offset in it, number of the piece or -1 for a run of words)
        for which, (_, text, k) in enumerate(self.items):
            need = max(1, min(3, len(text) // 4 - k)) if k else 1
            self.need.append(need)
            cut = [len(text) * p // (k + need) for p in range(k + need + 1)]
            for number, (a, b) in enumerate(zip(cut, cut[1:])):
                if b > a:
                    pieces[text[a:b]].append((which, a, number))
            words, differ = self.words[which], self.differ[which]
            if differ:
                for p in range(differ + 1):
                    a, b = len(words) * p // (differ + 1), len(words) * (p + 1) // (differ + 1)
                    pieces[" ".join(words[a:b])].append((which, len(" ".join(words[:a])) + (a > 0), -1))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def verify(self, which: int, text: str, lo: int, hi: int) -> tuple[int, int, int] | None:
        """``(distance, start, end)`` of the best occurrence within ``text[lo:hi]``, if it is within either budget."""
        _, item, k = self.items[which]
        exact = text.find(item, max(lo, 0), hi)
        if exact >= 0:
            return 0, exact, exact + len(item)
        if not k:
            return None
        if which not in self.forward:
            self.forward[which], self.backward[which] = Myers(item), Myers(item[::-1])
        lo = max(lo, 0)
        best, end = len(item) + 1, 0
        for at, score in enumerate(self.forward[which].columns(text[lo:hi])):
            if score < best:
                best, end = score, lo + at + 1
        if best > k and not self.reworded(which, text[lo:hi]):
            return None
        back = text[max(0, end - len(item) - best): end][::-1]
        for length, score in enumerate(self.backward[which].columns(back, anchored=True), 1):
            if score == best:
                return best, end - length, end
        return best, end, end

    def reworded(self, which: int, part: str) -> bool:
        """Whether the item occurs in ``part`` with few enough words put in, left out or exchanged."""
        if not self.differ[which]:
            return False
        if which not in self.wordly:
            self.wordly[which] = Myers(self.words[which])
        return min(self.wordly[which].columns(part.split(" ")), default=len(part)) <= self.differ[which]

    def candidates(self, which: int, hits: list[tuple[int, int]]):
        """Diagonals that hold as many pieces as an occurrence must, or a run of words."""
        k, need, runs = self.items[which][2], self.need[which], {d for d, number in hits if number < 0}
        if len(hits) < need and not runs:
            return []
        if need == 1:
            return sorted({d for d, _ in hits})
        hits = sorted(hit for hit in hits if hit[1] >= 0)
        found, held, first = runs, defaultdict(int), 0
        for d, number in hits:
            held[number] += 1
            while hits[first][0] < d - k:
                old = hits[first][1]
                held[old] -= 1
                if not held[old]:
                    del held[old]
                first += 1
            if len(held) >= need:
                found |= {hits[first][0], d}
        return sorted(found)

    def find(self, text: str):
        """``(item key, distance, start, end)`` per occurrence; candidates on nearby diagonals are one occurrence."""
        starts = defaultdict(list)
        for end, (length, places) in self.automaton.iter(text):
            for which, offset, number in places:
                starts[which].append((end - length + 1 - offset, number))
        for which in sorted(starts):
            key, item, k = self.items[which]
            reach = k + LONGEST if self.differ[which] else k
            group: list[int] = []
            hits = []
            for d in [*self.candidates(which, starts[which]), None]:
                if group and (d is None or d - group[-1] > k + len(item) // 2):
                    hits.append(self.verify(which, text, group[0] - reach, group[-1] + len(item) + reach))
                    group = []
                group.append(d)
            told: list[tuple[int, int, int]] = []  # the reach of two groups may hold the same occurrence, or a part of it
            for hit in sorted(filter(None, hits)):
                if all(hit[1] >= end or hit[2] <= start for _, start, end in told):
                    told.append(hit)
            for hit in sorted(told, key=lambda hit: hit[1]):
                yield key, *hit


def _blocks(items: DataFrame, block_chars: int):
    held, chars = [], 0
    for key, text in items.toLocalIterator():
        text = normalise(text)
        if not text:
            continue
        if held and chars + len(text) > block_chars:
            yield held
            held, chars = [], 0
        held.append((key, text))
        chars += len(text)
    if held:
        yield held


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
               item_text: str = "text", error_rate: float = 0.06, piece_chars: int = 16,
               block_chars: int = 2_000_000) -> DataFrame:
    """``(key, item, distance, start_char, end_char)`` per occurrence of a benchmark item in a text.

    Positions count characters of the normalised text. Overlapping candidates of an item count once, the nearest is told
    (ties: the first). Null and empty texts hold nothing; null and empty items are nowhere; repeated rows are told each
    time; equal items are told each. Other columns are ignored. Without documents or items the result is empty.
    """
    schema = T.StructType([T.StructField("doc", docs.schema[key].dataType), T.StructField("item", benchmark.schema[item].dataType),
                           T.StructField("distance", T.IntegerType()), T.StructField("start_char", T.LongType()),
                           T.StructField("end_char", T.LongType())])
    kinds = [pa.int32(), pa.int64(), pa.int64()]
    rows = docs.select(F.col(key).alias("doc"), F.col(text).cast("string").alias("text"))
    spark, out = docs.sparkSession, None
    for block in _blocks(benchmark.select(F.col(item), F.col(item_text).cast("string")), block_chars):
        shared = spark.sparkContext.broadcast(block)

        def work(batches, shared=shared):
            matcher = None
            for batch in thrifty(batches):
                matcher = matcher or Matcher(shared.value, error_rate, piece_chars)
                who, found = [], []
                for row, value in enumerate(batch.column(1)):
                    for hit in matcher.find(normalise(value.as_py())):
                        who.append(row)
                        found.append(hit)
                if who:
                    columns = list(zip(*found))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(who)), pa.array(columns[0]), *map(pa.array, columns[1:], kinds)],
                        names=schema.names)

        part = rows.mapInArrow(work, schema)
        out = part if out is None else out.union(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    return out.withColumnsRenamed({"doc": key, "item": item})


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; rows with a null key stay."""
    leaks = stage(find_leaks(docs, benchmark, key, **options).select(key).distinct(), "leaks")
    return drop_ids(docs, leaks, key)
