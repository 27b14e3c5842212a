"""Bounded-space online best-fit packing of documents into token sequences.

A document is its ids and an end id. Only documents longer than a sequence are cut, into whole sequences and a rest. Pieces are dealt evenly into tasks
of about GROUP_PIECES (round robin over a written table, so no key can be hot); each task takes its pieces as they arrive and offers each to at most OPEN_BINS open
bins. A bitset has a bit for each free space that some open bin has: the lowest set bit at or above a piece's length is the best fit. When all bins are
open and a piece fits none, the fullest closes for a new one. A piece goes on as soon as it is placed, so a task holds the open bins and one batch of rows.

Null text counts as empty: a piece of the end id alone. Repeated rows are packed each. Columns other than doc_id and text are ignored; an empty
table gives no piece; sequences are numbered by task and bin.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns, small_batches, written
from .tokens import encoder

SEQUENCE = 2_048
OPEN_BINS = 64
GROUP_PIECES = 65_536


class BestFit:
    """At most `most` open bins of `space`; put(length) gives (bin, offset)."""

    def __init__(self, space: int, most: int):
        self.space, self.most, self.bits, self.open, self.next = space, most, 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(space + 1)]

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        b = bins.pop()
        if not bins:
            self.bits ^= 1 << free
        self.open -= 1
        return b

    def put(self, length: int) -> tuple[int, int]:
        fits = self.bits >> length
        if fits:
            free = length + ((fits & -fits).bit_length() - 1)
            b = self._take(free)
        else:
            if self.open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, b = self.space, self.next
            self.next += 1
        if left := free - length:
            self.by_free[left].append(b)
            self.bits |= 1 << left
            self.open += 1
        return b, self.space - free


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, sequence: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece of every row."""
    small_batches(docs.sparkSession)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def cut(batches: Iterator[dict]) -> Iterator[dict]:
        encode, end, step = encoder(tokenizer_path), struct.pack("<I", end_id), 4 * sequence
        for batch in batches:
            rows = []
            for d, text in zip(batch["doc_id"], batch["text"], strict=True):
                raw = encode(text) + end
                for k, at in enumerate(range(0, len(raw), step)):
                    part = raw[at : at + step]
                    rows.append((d, k, at // 4, len(part) // 4, zlib.crc32(part), *([list(struct.unpack(f"<{len(part) // 4}I", part))] if with_ids else ())))
            yield dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))

    return map_columns(docs.select("doc_id", "text"), cut, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)


def pack(cut: DataFrame, sequence: int = SEQUENCE, open_bins: int = OPEN_BINS, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """The rows of cut with sequence_id and offset."""
    cut = written(cut, "pieces")
    tasks = max(1, round(cut.count() / group_pieces))

    def place(batches: Iterator[dict]) -> Iterator[dict]:
        task, bins = TaskContext.get().partitionId(), BestFit(sequence, open_bins)
        for batch in batches:
            put = [bins.put(n) for n in batch["length"]]
            yield batch | {"sequence_id": [(task << 32) + b for b, _ in put], "offset": [o for _, o in put]}

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)
    return map_columns(cut.repartition(tasks), place, schema + ", sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, sequence: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    return pack(pieces(docs, tokenizer_path, end_id, sequence, with_ids), sequence)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids of each sequence, from pieces packed with their ids; a group holds one sequence's ids at most."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))
