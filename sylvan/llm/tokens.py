"""Token ids as compressed binary blocks with a shared dictionary.

Written under one path, by Spark's committer (a lost task's output vanishes and is written again):

- dictionary: one row with the zstandard dictionary and its SHA-256;
- blocks: shard, block, ids, first_doc, last_doc (the least and the greatest doc_id in it) and data; shards are ranges of doc_id, in order, null doc_ids first, so
  parquet's statistics lead to a document's block (read_document). The bytes of data:

    magic "TIDZ0001" | u32 documents n | u32 bytes per id (2 or 4) | 32 bytes SHA-256 of the dictionary (zeros: none)
    | u64 ids before the block in its shard | n x u8 has an id | n x i64 doc_id | n x u32 ids | (n+1) x u64 offsets | zstandard frames

all little-endian. Each document is a frame of its own, made with a dictionary trained on serialized id arrays, so one document is read by one
slice and one small decompression (read_one).

Null text counts as empty (its ids are the end id alone); texts of any length are encoded whole; repeated rows and equal doc_ids each keep a row of
their own (in order of a hash of the text, so that no doc_id and no null is too many rows for one task); columns other than doc_id and text are ignored; an empty table writes no block.
"""

from __future__ import annotations

import hashlib
import os
import struct
import zlib
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns, new_path, small_batches

MAGIC = b"TIDZ0001"
#: A block ends at so many documents or bytes of frames.
BLOCK_DOCS = 256
BLOCK_BYTES = 4 << 20
#: The dictionary is trained on this many documents at most, of at most SAMPLE_CHARS characters each (the first that a scan
#: gives; only the compression depends on them), in pieces of SAMPLE_PIECE bytes.
SAMPLE_DOCS = 256
SAMPLE_CHARS = 65_536
SAMPLE_PIECE = 2_048
DICTIONARY_BYTES = 65_536
LEVEL = 3
#: Entries of each of the two generations of a worker's memo from white-space-free pieces of text to their ids.
MEMO = 700_000
#: Signs that a word's letters never share a token with.
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

_encoders: dict[str, Encoder] = {}


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Memo(dict):
    """Pieces to ids; what an older generation still has is taken from there, and everything else is worked out once."""

    def __init__(self, work):
        super().__init__()
        self.work, self.old = work, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.work(piece)
        self[piece] = ids
        return ids

    def trim(self) -> None:
        if len(self) > MEMO:
            self.old = dict(self)
            self.clear()


class Encoder:
    """Ids of whole texts as little-endian u32 bytes, by a tokenizers file whose tokens never span a space or line feed.

    Texts are cut at those two characters, and the library encodes each distinct piece about once per worker: a word of Latin-1 letters, with ASCII signs after it
    or none, by its model alone, any other piece by the whole tokenizer. Whether the file allows either is tried on construction; a tokenizer that
    keeps white space gets whole texts.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.signs: dict[str, bytes] = {}
        probe = "One  two,\n\nthree's \u00e9t\u00e9 4\u00b5 !? x\n \u0301y"
        self.splits = self._ids(probe) == b"".join(self._ids(x) for x in probe.replace("\n", " ").split(" "))
        words = ["Word", "thonble,", "\u00c9t\u00e9", "stra\u00dfe.", "HEIT!!", "a", "x...", "\u00e7a&&&", "don'", "\u00aa", "\u00b5m%)"]
        self.by_model = self.splits and all(self._word(x) == self._ids(x) for x in words)
        self.memo = _Memo(self._piece)

    @property
    def width(self) -> int:
        return 2 if self.tokenizer.get_vocab_size() <= 65_536 else 4

    def _ids(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, piece: str) -> bytes | None:
        """The ids of letters and the signs after them; None if the piece is anything else."""
        core = piece.rstrip(SIGNS)
        if not core.isalpha() or max(core) > "\u00ff":
            return None
        low = core.lower()
        if not low.isascii():
            low = low.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(low)]
        signs = piece[len(core) :]
        if signs and signs not in self.signs:
            self.signs[signs] = self._ids(signs)
        return struct.pack(f"<{len(ids)}I", *ids) + self.signs.get(signs, b"")

    def _piece(self, piece: str) -> bytes:
        if not piece:
            return b""
        return (self._word(piece) if self.by_model else None) or self._ids(piece)

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.splits:
            return self._ids(text)
        self.memo.trim()
        if len(self.signs) > MEMO:
            self.signs.clear()
        return b"".join(map(self.memo.__getitem__, text.replace("\n", " ").split(" ")))


def encoder(path: str) -> Encoder:
    """The worker's encoder for this file; it lives as long as the worker does."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def train_dictionary(docs: DataFrame, tokenizer_path: str) -> bytes:
    """A zstandard dictionary from a bounded sample of documents; empty if there is too little to train on."""
    import zstandard

    sample = docs.select("text").where((F.length("text") > 0) & (F.length("text") <= SAMPLE_CHARS)).limit(SAMPLE_DOCS).collect()
    encode = encoder(tokenizer_path)
    pieces = []
    for row in sample:
        ids = _narrow(encode(row["text"]), encode.width)
        pieces += [ids[i : i + SAMPLE_PIECE] for i in range(0, len(ids), SAMPLE_PIECE)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _narrow(ids: bytes, width: int) -> bytes:
    import numpy as np

    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def _wide(ids: bytes, width: int) -> bytes:
    import numpy as np

    return ids if width == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()


def pack_block(doc_ids: list, counts: list[int], frames: list[bytes], width: int, dictionary: bytes, before: int) -> bytes:
    offsets = [0]
    for f in frames:
        offsets.append(offsets[-1] + len(f))
    n = len(frames)
    head = MAGIC + struct.pack("<II", n, width) + (hashlib.sha256(dictionary).digest() if dictionary else bytes(32)) + struct.pack("<Q", before)
    return head + bytes(d is not None for d in doc_ids) + struct.pack(f"<{n}q", *(d or 0 for d in doc_ids)) + struct.pack(f"<{n}I", *counts) + struct.pack(f"<{n + 1}Q", *offsets) + b"".join(frames)


class Block:
    """A view of a block's bytes."""

    def __init__(self, data: bytes, dictionary: bytes):
        import zstandard

        self.n, self.width = struct.unpack_from("<II", data, 8)
        want = hashlib.sha256(dictionary).digest() if dictionary else bytes(32)
        if data[:8] != MAGIC or data[16:48] != want:
            raise ValueError("not a block of token ids, or made with another dictionary")
        self.before = struct.unpack_from("<Q", data, 48)[0]
        at, n = 56, self.n
        ids = struct.unpack_from(f"<{n}q", data, at + n)
        self.doc_ids = [i if has else None for has, i in zip(data[at : at + n], ids, strict=True)]
        self.counts = struct.unpack_from(f"<{n}I", data, at + 9 * n)
        self.offsets = struct.unpack_from(f"<{n + 1}Q", data, at + 13 * n)
        self.data, self.start = data, at + 13 * n + 8 * (n + 1)
        self.decompress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None).decompress

    def read_one(self, i: int) -> bytes:
        """Document i's ids as u32 bytes; only its own frame is touched."""
        ids = _wide(self.decompress(self.data[self.start + self.offsets[i] : self.start + self.offsets[i + 1]]), self.width)
        if len(ids) != 4 * self.counts[i]:
            raise ValueError("a frame has another number of ids than the index says")
        return ids


BLOCKS = "shard int, block int, ids bigint, first_doc bigint, last_doc bigint, data binary"


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int, path: str | None = None, dictionary: bytes | None = None) -> str:
    """Encode every row, write dictionary and blocks under path (new in the shared folder if none is given); returns the path."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    path = path or new_path(spark, "tokens")
    dictionary = train_dictionary(docs, tokenizer_path) if dictionary is None else dictionary
    row = F.unhex(F.lit(dictionary.hex()))
    spark.range(1, numPartitions=1).select(row.alias("dictionary"), F.sha2(row, 256).alias("sha256")).write.parquet(f"{path}/dictionary")

    def blocks(batches: Iterator[dict]) -> Iterator[dict]:
        import zstandard

        encode, shard = encoder(tokenizer_path), TaskContext.get().partitionId()
        compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None).compress
        end, state = struct.pack("<I", end_id), {"n": 0, "before": 0}
        ids, counts, frames = [], [], []

        def flush():
            total = sum(counts)
            own = [d for d in ids if d is not None]
            ends = {"first_doc": [min(own, default=None)], "last_doc": [max(own, default=None)]}
            row = {"shard": [shard], "block": [state["n"]], "ids": [total], **ends, "data": [pack_block(ids, counts, frames, encode.width, dictionary, state["before"])]}
            state["n"], state["before"] = state["n"] + 1, state["before"] + total
            for x in (ids, counts, frames):
                x.clear()
            return row

        size = 0
        for batch in batches:
            for d, text in zip(batch["doc_id"], batch["text"], strict=True):
                raw = encode(text) + end
                frame = compress(_narrow(raw, encode.width))
                ids.append(d)
                counts.append(len(raw) // 4)
                frames.append(frame)
                size += len(frame)
                if len(ids) >= BLOCK_DOCS or size >= BLOCK_BYTES:
                    yield flush()
                    size = 0
        if ids:
            yield flush()

    ordered = docs.withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()}).repartitionByRange("doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row")
    map_columns(ordered.select("doc_id", "text"), blocks, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    return path


def read_dictionary(spark, path: str) -> bytes:
    row = spark.read.schema("dictionary binary, sha256 string").parquet(f"{path}/dictionary").first()
    if hashlib.sha256(row["dictionary"]).hexdigest() != row["sha256"]:
        raise ValueError("the dictionary is not the one that was written")
    return bytes(row["dictionary"])


def read_document(spark, path: str, doc_id: int) -> list[list[int]]:
    """The ids of every row of one doc_id: only blocks whose range has it are read, and of those only its frames."""
    dictionary, out = read_dictionary(spark, path), []
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").where((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id))
    for row in blocks.orderBy("shard", "block").select("data").toLocalIterator():
        block = Block(bytes(row["data"]), dictionary)
        out += [list(struct.unpack(f"<{block.counts[i]}I", block.read_one(i))) for i, d in enumerate(block.doc_ids) if d == doc_id]
    return out


def read_tokens(spark, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document in the files under path; start counts the ids of all documents before it.

    Only the dictionary and one total a shard go to the driver, whose number is that of the write's partitions.
    """
    dictionary = read_dictionary(spark, path)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    totals = {r["shard"]: r["n"] for r in blocks.groupBy("shard").agg(F.sum("ids").alias("n")).collect()}
    base, at = {}, 0
    for shard in sorted(totals):
        base[shard], at = at, at + totals[shard]

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        import numpy as np

        for batch in batches:
            for shard, data in zip(batch["shard"], batch["data"], strict=True):
                block = Block(data, dictionary)
                raw = [block.read_one(i) for i in range(block.n)]
                start = base[shard] + block.before + np.cumsum([0, *block.counts[:-1]])
                out = {"doc_id": block.doc_ids, "start": start, "n_tokens": np.array(block.counts, "i8"), "ids_crc32": np.array([zlib.crc32(x) for x in raw], "i8")}
                if with_ids:
                    out["ids"] = [np.frombuffer(x, "<u4").astype("i4") for x in raw]
                yield out

    return map_columns(blocks.select("shard", "data"), rows, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)
