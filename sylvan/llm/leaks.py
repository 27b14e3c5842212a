"""Benchmark decontamination by pigeonhole edit matching on words.

A test item of n words (lower case, letters and digits only) may differ from a passage by e = floor(ERRORS n) words (0 for items under LEAST_WORDS). It
is split into e + 1 pieces; a passage within e edits has at least one piece unchanged. All pieces are searched at once in each whole text (an
Aho-Corasick automaton), and each hit's surroundings are compared with the item by Myers' bit-parallel edit distance.

The items are the query set: they are read in blocks of BLOCK_ITEMS, each a broadcast variable, and every text meets every block. The driver and a worker hold one block each
(a worker makes the next one's automaton when it gets there). An item of fewer than LEAST_WORDS words is found where it stands word for word, so a very common word as an
item is found in very many texts: a row each, as asked for.

Null or empty texts match nothing; items without a word are no queries; repeated rows give repeated results; equal items each give theirs. Other columns are kept as they
are, and the added one is called by the name asked for, with underscores after it while there is a column of that name; an empty table of either kind gives an empty result.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, small_batches, written

ERRORS = 0.1
LEAST_WORDS = 8
BLOCK_ITEMS = 20_000

HITS = "array<struct<item:bigint,edits:int,first_word:int,end_word:int>>"

_WORD = re.compile(r"[^\W_]+")
_matchers: dict[str, Matcher] = {}


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def budget(n: int, errors: float = ERRORS) -> int:
    return int(errors * n) if n >= LEAST_WORDS else 0


def pieces(n: int, parts: int) -> list[tuple[int, int]]:
    """(from, to) of `parts` pieces of n words, as even as can be; parts <= n."""
    edges = [n * i // parts for i in range(parts + 1)]
    return list(zip(edges, edges[1:], strict=False))


class Pattern:
    """An item's words as bit masks, forwards and backwards."""

    def __init__(self, item: list[str]):
        self.n = len(item)
        self.ahead, self.back = self._masks(item), self._masks(item[::-1])

    @staticmethod
    def _masks(item: list[str]) -> dict[str, int]:
        out: dict[str, int] = {}
        for i, w in enumerate(item):
            out[w] = out.get(w, 0) | 1 << i
        return out

    def _scores(self, text: list[str], masks: dict[str, int], anchored: bool) -> Iterator[int]:
        """After each word: the least edits that make the item end there; anchored: of the text from its first word."""
        full, top = (1 << self.n) - 1, 1 << (self.n - 1)
        plus, minus, score = full, 0, self.n
        for w in text:
            eq = masks.get(w, 0)
            xv = eq | minus
            xh = (((eq & plus) + plus) ^ plus) | eq
            ph, mh = minus | ~(xh | plus) & full, plus & xh
            score += bool(ph & top) - bool(mh & top)
            ph, mh = ((ph << 1) | anchored) & full, (mh << 1) & full
            plus, minus = (mh | ~(xv | ph)) & full, ph & xv
            yield score

    def best(self, text: list[str]) -> tuple[int, int, int]:
        """(edits, from, to) of the closest passage of text, the first and then the longest of equal ones."""
        edits, to = min(((s, i + 1) for i, s in enumerate(self._scores(text, self.ahead, False))), default=(self.n, 0))
        length = max((i + 1 for i, s in enumerate(self._scores(text[:to][::-1], self.back, True)) if s == edits), default=0)
        return edits, to - length, to


class Matcher:
    """Finds items in texts. items: (index, words)."""

    def __init__(self, items: list[tuple[int, list[str]]], errors: float):
        import ahocorasick

        self.patterns, self.budgets, found = {}, {}, {}
        for k, item in items:
            if item:
                self.patterns[k], self.budgets[k] = Pattern(item), budget(len(item), errors)
                for a, b in pieces(len(item), self.budgets[k] + 1):
                    found.setdefault(f" {' '.join(item[a:b])} ", []).append((k, a))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        if found:
            self.automaton.make_automaton()
        self.any = bool(found)

    def __call__(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item, edits, from, to) for each item within its budget; from and to count words; the closest passage, the first of equal ones."""
        if not text or not self.any:
            return []
        whole = None
        flat = f" {' '.join(words(text))} "
        starts: dict[int, set[int]] = {}
        at, n = 0, 0
        for end, (length, where) in self.automaton.iter(flat):
            begin = end - length + 1
            if begin >= at:
                n, at = n + flat.count(" ", at, begin), begin
                first = n
            else:  # another piece that ends here or nearby began earlier
                first = n - flat.count(" ", begin, at)
            for k, a in where:
                starts.setdefault(k, set()).add(first - a)
        out = []
        for k, begins in starts.items():
            whole = whole if whole is not None else flat.split()
            size, most, best, seen = self.patterns[k].n, self.budgets[k], None, -1
            for b in sorted(begins):
                if b <= seen:  # the last window covers this one
                    continue
                low = max(0, b - most)
                # one window for all places of the item that lie within its budget of each other
                high = b + size + most
                last = b
                for c in sorted(x for x in begins if b < x <= b + 2 * most):
                    high, last = c + size + most, c
                seen = last
                edits, f, t = self.patterns[k].best(whole[low:high])
                if edits <= most and (best is None or edits < best[1]):
                    best = (k, edits, low + f, low + t)
            if best:
                out.append(best)
        return sorted(out)


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, list[str]]]]:
    block: list[tuple[int, list[str]]] = []
    for r in items.select("item_id", "text").where("item_id is not null").orderBy("item_id", "text").toLocalIterator():
        block.append((r["item_id"], words(r["text"])))
        if len(block) >= BLOCK_ITEMS:
            yield block
            block = []
    if block:
        yield block


def _hits(spark: SparkSession, block: list[tuple[int, list[str]]], errors: float, text: Column) -> Column:
    mark, shared = uuid.uuid4().hex, spark.sparkContext.broadcast(block)

    @F.pandas_udf(HITS)
    def hits(texts: pd.Series) -> pd.Series:
        if mark not in _matchers:
            _matchers.clear()
            _matchers[mark] = Matcher(shared.value, errors)
        find = _matchers[mark]
        return pd.Series([[dict(zip(("item", "edits", "first_word", "end_word"), h, strict=True)) for h in find(t)] for t in texts])

    return hits(text)


def with_hits(docs: DataFrame, items: DataFrame, errors: float = ERRORS, name: str = "hits") -> DataFrame:
    """docs with an array of the items (item_id) that each whole text contains within their budgets. Several blocks are a pass over the texts each, through
    written tables, so that no worker goes back and forth between them."""
    spark, name = docs.sparkSession, free_name(docs, name)
    small_batches(spark)
    out, before = docs.withColumn(name, F.array().cast(HITS)), False
    for block in _blocks(items):
        out = written(out, "hits") if before else docs
        own = _hits(spark, block, errors, F.col("text"))
        out, before = out.withColumn(name, F.concat(name, own) if before else own), True
    return out


def contaminated(docs: DataFrame, items: DataFrame, errors: float = ERRORS) -> DataFrame:
    """doc_id, item_id, edits, first_word, end_word for each document that contains an item."""
    found = with_hits(docs.select("doc_id", "text"), items, errors).select("doc_id", F.explode("hits").alias("h"))
    return found.select("doc_id", F.col("h.item").alias("item_id"), "h.edits", "h.first_word", "h.end_word")
