"""SimHash near-duplicates by pivot distance tables.

Every distinct fingerprint's Hamming distances to PIVOTS fixed reference fingerprints are computed once and written beside it. By the triangle inequality two
fingerprints within r bits differ by at most r at each pivot, so a pair whose tables differ by more at any coordinate is discarded unseen; survivors are
verified by popcount.

Which pairs are looked at (linked()): fingerprints that agree on one of a set of bit masks and lie next to each other when sorted by their distance to the first
pivot (the scan ends where that differs by more than r). The 64 bits are cut into blocks, and a mask is all but r of them: two fingerprints within r
bits agree on one at least, so no pair is lost. There are as many blocks as keep a run of equal masked bits short at any number of fingerprints (block_masks).

A run of equal masked bits longer than LONG_RUN (a dense group) isn't compared in pairs: its fingerprints are linked exactly through the values one bit away (two
fingerprints within two bits of each other have such a value in common, or one is a value of the other), 65 rows each, so work is linear in a
group of any size. Equal fingerprints are one node from the start.

near_duplicate_groups() finds texts of a given similarity of shingle sets, for which SimHash alone has no exact search: 0.8 is about 19 of 128 bits. Bands of
min-hashes bring texts together, SimHash fingerprints and their pivot tables discard pairs, and whole shingle sets are compared.

Null text counts as empty. An empty text, having no word, has fingerprint 0. Repeated rows have equal fingerprints and one component. Null doc_ids
take part but never name a component. Columns other than doc_id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, forget, map_columns, small_batches, written

PIVOTS = 16
LONG_RUN = 512
#: Random fingerprints that a run of equal masked bits should hold at most, on average.
RUN = 64
SEED = 42
#: Similar pairs for near_duplicate_groups: words in a shingle, Jaccard similarity, min-hashes in a band, and the probability with which a pair of just that
#: similarity has a band in common (more alike pairs: a higher one), which sets the number of bands: 29 at 0.8, whatever the number of texts.
SHINGLE = 5
SIMILARITY = 0.8
BAND = 5
MEETS = 0.99999
#: Bits of the 128 of two SimHashes in which texts to be compared may differ. At 0.8 they differ in 19 of them on average, and in 24 at worst (sets of four and five
#: shingles), with standard deviations of 4.0 and 4.4: one such pair in 10^6 is beyond this.
MOST_BITS = 44
#: Earlier neighbours in a run of equal bands to which near_duplicate_groups compares a fingerprint at first. Runs up to SMALL rows hand on pairs to be verified; in
#: larger ones they are verified where they meet, two blocks of about BLOCK shingles and BLOCK_ROWS texts at most at a time.
NEIGHBOURS = 512
SMALL = 8
BLOCK = 1 << 20
BLOCK_ROWS = 2_048


def shingles(text: str | None, size: int) -> list[bytes]:
    """The text's shingles, repeats included; fewer words than size: the whole sequence; no word: none. Only A-Z are lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return []
    return [b" ".join(w) for w in zip(*(words[i:] for i in range(size)), strict=False)] or [b" ".join(words)]


def hashes(text: str | None, size: int):
    import numpy as np
    from xxhash import xxh64_intdigest

    return np.array([xxh64_intdigest(s, SEED) for s in shingles(text, size)], "u8")


def simhash(h) -> int:
    """Bit i is 1 if it is set in over half of the hashes."""
    import numpy as np

    counts = np.zeros(64, "i8")
    for at in range(0, len(h), 65_536):
        counts += np.unpackbits(h[at : at + 65_536].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="i8")
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<i8")[0])


def pivots(n: int = PIVOTS):
    """n reference fingerprints, fixed by a seed."""
    import numpy as np

    return np.random.default_rng(SEED).integers(0, 2**64, n, "u8")


def with_table(fps: DataFrame) -> DataFrame:
    """fps with its pivot distance table: eight distances a bigint (t0, t1, ...), and the first one as d."""
    distance = lambda p: F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(int(p)))))
    packed = {}
    for i, p in enumerate(pivots()):
        packed.setdefault(f"t{i // 8}", []).append(F.shiftleft(distance(p).cast("bigint"), 8 * (i % 8)))
    sums = {name: parts[0] for name, parts in packed.items()}
    for name, parts in packed.items():
        for x in parts[1:]:
            sums[name] = sums[name].bitwiseOR(x)
    return fps.withColumns({"d": distance(pivots()[0]).cast("int")} | sums)


def _table(rows: dict):
    """The pivot distance table (rows x pivots) of columns t0, t1, ..."""
    import numpy as np

    return np.stack([rows[f"t{i}"].astype("<i8") for i in range(PIVOTS // 8)], axis=1).view("u1").astype("i2")


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, fp (bigint: the 64 bits) of every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            yield {"doc_id": b["doc_id"], "fp": [simhash(hashes(t, size)) for t in b["text"]]}

    return map_columns(docs.select("doc_id", "text"), run, "doc_id bigint, fp bigint")


def block_masks(n: int, bits: int = 2) -> list[int]:
    """Masks of which any two fingerprints within `bits` agree on one: all unions of all but `bits` of k blocks; as few blocks as keep random runs of n short."""
    for k in range(bits + 1, bits + 5):
        edges = [64 * i // k for i in range(k + 1)]
        blocks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
        masks = [sum(some) for some in combinations(blocks, k - bits)]
        if n <= RUN << min(m.bit_count() for m in masks):
            break
    return masks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _runs(batches: Iterator[dict], long: int, rows: int = 65_536) -> Iterator[tuple[bool, dict]]:
    """(is part of a run longer than `long`, columns), for rows sorted by (mask, bits); other runs come whole, many at a time."""
    import numpy as np

    def split(rows: dict) -> Iterator[tuple[bool, dict]]:
        lengths = np.diff(np.append(_starts(rows), len(rows["mask"])))
        in_long = np.repeat(lengths > long, lengths)
        for is_long in (True, False):
            if (in_long == is_long).any():
                yield is_long, {k: v[in_long == is_long] for k, v in rows.items()}

    held, running = None, None  # running: the key of a long run whose first rows have been given
    for now in _gathered(batches, rows):
        if running is not None:
            same = (now["mask"] == running[0]) & (now["bits"] == running[1])
            n = len(same) if same.all() else int((~same).argmax())
            if n:
                yield True, {k: v[:n] for k, v in now.items()}
            if n == len(same):
                continue
            now, running = {k: v[n:] for k, v in now.items()}, None
        if held is not None:
            now = {k: np.concatenate([held[k], v]) for k, v in now.items()}
        last = int(_starts(now)[-1])
        if last:
            yield from split({k: v[:last] for k, v in now.items()})
        held = {k: v[last:] for k, v in now.items()}
        if len(held["mask"]) > long:
            yield True, held
            running, held = (held["mask"][0], held["bits"][0]), None
    if held is not None:
        yield from split(held)


def _gathered(batches: Iterator[dict], rows: int) -> Iterator[dict]:
    import numpy as np

    some: list[dict] = []
    for b in batches:
        some.append(b)
        if sum(len(x["mask"]) for x in some) >= rows:
            yield {k: np.concatenate([x[k] for x in some]) for k in b}
            some = []
    if some and sum(len(x["mask"]) for x in some):
        yield {k: np.concatenate([x[k] for x in some]) for k in some[0]}


def _starts(rows: dict):
    """Where each run of equal (mask, bits) begins."""
    import numpy as np

    new = (rows["mask"][1:] != rows["mask"][:-1]) | (rows["bits"][1:] != rows["bits"][:-1])
    return np.flatnonzero(np.append(True, new))


def _neighbours(rows: dict, radius: int, most: int) -> Iterator[tuple]:
    """(i, j) index arrays of pairs of one run with tables that differ by radius at most at the first pivot, by growing offset."""
    import numpy as np

    starts = _starts(rows)
    run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(rows["mask"]))))
    d = rows["d"].astype("i4")
    i = np.arange(len(run))
    for offset in range(1, most + 1):
        i = i[i + offset < len(run)]
        i = i[(run[i] == run[i + offset]) & (d[i + offset] - d[i] <= radius)]
        if not len(i):
            return
        yield i, i + offset


def _map_arrays(df: DataFrame, body, schema: str) -> DataFrame:
    """As map_columns, but with numpy arrays in; for columns without nulls."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        import pyarrow as pa

        for out in body({n: b.column(n).to_numpy(zero_copy_only=False) for n in b.schema.names} for b in batches):
            yield pa.RecordBatch.from_pydict(out, schema=kinds)

    return df.mapInArrow(run, schema)


def _forest(a, b) -> list[tuple[int, int]]:
    """Of the links, those that a union-find needs to connect what all of them connect."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = p
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        if (p := top(x)) != (q := top(y)):
            parent[p] = q
            kept.append((x, y))
    return kept


def linked(fps: DataFrame, bits: int = 2, masks: list[int] | None = None) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that connect exactly those that a chain of pairs within `bits` (at most 2) connects."""
    if not 0 <= bits <= 2:
        raise ValueError("long runs are linked exactly for 2 bits at most")
    tables = [f"t{i}" for i in range(PIVOTS // 8)]
    if not {"d", *tables} <= set(fps.columns):
        fps = with_table(fps)
    masks = block_masks(fps.count(), bits) if masks is None else masks
    masked = F.explode(F.array(*(F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for i, m in enumerate(masks))))
    rows = fps.select("fp", "d", *tables, masked.alias("m")).select("m.mask", "m.bits", "d", "fp", *tables)
    rows = rows.repartition("mask", "bits").sortWithinPartitions("mask", "bits", "d")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        import numpy as np

        flips = np.append(np.uint64(0), np.uint64(1) << np.arange(64, dtype="u8"))
        for is_long, part in _runs(batches, LONG_RUN):
            fp = part["fp"].astype("i8").view("u8")
            if is_long:
                for at in range(0, len(fp), 1024):
                    own = fp[at : at + 1024]
                    yield {"by": np.ones(len(own) * 65, bool), "a": np.repeat(own, 65).view("i8"), "b": (own[:, None] ^ flips[None, :]).ravel().view("i8")}
                continue
            table, a, b = _table(part), [], []
            for i, j in _neighbours(part, bits, LONG_RUN):
                near = np.abs(table[i] - table[j]).max(axis=1) <= bits
                i, j = i[near], j[near]
                near = np.bitwise_count(fp[i] ^ fp[j]) <= bits
                a.append(fp[i[near]].view("i8"))
                b.append(fp[j[near]].view("i8"))
            if kept := _forest(np.concatenate(a), np.concatenate(b)) if a else []:
                yield {"by": [False] * len(kept), "a": [x for x, _ in kept], "b": [y for _, y in kept]}

    found = written(_map_arrays(rows, run, "by boolean, a bigint, b bigint"), "found")
    through = found.where("by").select("a", "b").distinct()
    hub = through.groupBy("b").agg(F.min("a").alias("h"))
    return found.where("not by").select("a", "b").unionByName(through.join(hub, "b").select("a", F.col("h").alias("b")).where("a <> b").distinct())


def simhash_components(docs: DataFrame, size: int = 3, bits: int = 2) -> DataFrame:
    """doc_id, fp, component_id of every row: the smallest doc_id that a chain of fingerprints within `bits` reaches."""
    own = written(fingerprints(docs, size), "fingerprints")
    nodes = written(with_table(own.groupBy("fp").agg(F.min("doc_id").alias("least"))), "nodes")
    roots = written(components(linked(nodes, bits)), "roots")
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return own.join(_named(rooted, "least"), "fp").select("doc_id", "fp", "component_id")


def _named(rooted: DataFrame, least: str) -> DataFrame:
    names = rooted.groupBy("root").agg(F.min(least).alias("component_id"))
    return rooted.join(names, "root").drop("root", least)


def bands(similarity: float = SIMILARITY) -> int:
    """How many bands a pair of just that similarity needs to have one in common with probability MEETS."""
    import math

    meet = similarity**BAND
    return max(1, math.ceil(math.log(1 - MEETS) / math.log(1 - meet))) if meet < 1 else 1


def _key(text: Column, clashes: list[int]) -> Column:
    """A text's 64-bit name; another one for those that share it with a different text."""
    key = F.xxhash64(text)
    return F.when(key.isin(clashes), F.xxhash64(F.lit("again"), F.lit(len(clashes)), text)).otherwise(key) if clashes else key


def keyed(docs: DataFrame) -> tuple[DataFrame, list[int]]:
    """doc_id, text (null: empty) and text_key of every row, different texts with different keys, and the keys that were first given to several texts. A second hash
    tells which: some n^2 / 2^65 of n texts, few enough for a list at any size."""
    docs, known = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), []
    while True:
        out = docs.withColumn("text_key", _key(F.col("text"), known))
        second = F.xxhash64(F.lit("second"), "text")
        found = out.groupBy("text_key").agg(F.min(second).alias("lo"), F.max(second).alias("hi")).where("lo <> hi").select("text_key").collect()
        if not found:
            return out, known
        known = sorted({*known, *(r[0] for r in found)})


def near_duplicate_groups(docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, text_key, group, keeper of every row: equal texts share a text_key, and chains of pairs whose shingle sets have Jaccard similarity of
    `similarity` or more share a group; keeper is true for the smallest doc_id (nulls last) of a group.

    Each distinct text has bands() band hashes of BAND min-hashes, and two SimHashes. Texts with a band in common meet; in such a run they are compared, by pivot tables,
    popcount and the sizes of their sets, with their neighbours, and of the pairs within MOST_BITS a spanning forest of least distances becomes candidates (_spanning): at most one
    pair a text, yet all that the run's pairs connect. Every candidate pair's whole shingle sets are compared, and those alike are joined. Then all other
    pairs within MOST_BITS whose texts are not joined yet are compared too: those of small runs as pairs, those of larger ones in the run, which their shingle sets are
    sent to, so that only links come out of it however many pairs there are (_alike). A run of any length is cut into blocks of which every two meet (_cells).
    """
    return _groups(keyed(docs)[0], size, similarity)


def _groups(docs: DataFrame, size: int, similarity: float) -> DataFrame:
    import numpy as np

    small_batches(docs.sparkSession)
    own = written(_map_words(docs, size, similarity), "own")
    nodes = written(own.groupBy("text_key").agg(F.min("doc_id").alias("least"), *(F.first(c).alias(c) for c in ("n", "fp0", "fp1", "bands"))), "nodes")
    p, q = (_signed(int(x)) for x in pivots(2))
    distance = (F.bit_count(F.col("fp0").bitwiseXOR(F.lit(p))) + F.bit_count(F.col("fp1").bitwiseXOR(F.lit(q)))).cast("int").alias("d")

    def met(of: DataFrame, *more: str) -> DataFrame:
        rows = of.select("text_key", *more, "n", "fp0", "fp1", distance, F.posexplode("bands").alias("mask", "bits")).select("mask", "bits", "d", "text_key", *more, "n", "fp0", "fp1")
        return rows.repartition("mask", "bits").sortWithinPartitions("mask", "bits", "d")

    def joined(links: DataFrame) -> DataFrame:
        roots = written(components(links), "roots")
        return nodes.join(roots, nodes["text_key"] == roots["node"], "left").drop("node").withColumn("root", F.coalesce("root", "text_key"))

    def row_columns(part: dict, which) -> dict:
        key = part["text_key"].astype("i8")[which]
        return {"row": np.ones(len(key), bool), "mask": part["mask"][which], "a": key, "b": part["bits"][which]}

    def pair_columns(x: dict) -> dict:
        return {"row": np.zeros(len(x["a"]), bool), "mask": np.zeros(len(x["a"]), "i4")} | x

    def nearest(batches: Iterator[dict]) -> Iterator[dict]:
        for is_long, part in _runs(batches, NEIGHBOURS + 1):
            for x in _ordered(part["text_key"].astype("i8"), [_spanning(part, similarity)]):
                yield pair_columns(x)
            if is_long:
                yield row_columns(part, slice(None))

    def others(batches: Iterator[dict]) -> Iterator[dict]:
        for is_long, part in _runs(batches, NEIGHBOURS + 1):
            if is_long:
                continue
            part = _divided(part)
            starts = _starts(part) if len(part["mask"]) else np.zeros(0, "i8")
            lengths = np.diff(np.append(starts, len(part["mask"])))
            few, some = np.repeat(lengths <= SMALL, lengths), np.zeros(len(part["mask"]), bool)
            pairs = []
            for i, j in _across(part, similarity):
                pairs.append((i[few[i]], j[few[i]]))
                some[i[~few[i]]] = some[j[~few[i]]] = True
            for x in _ordered(part["text_key"].astype("i8"), pairs):
                yield pair_columns(x)
            if some.any():
                yield row_columns(part, some)

    def within(batches: Iterator[dict]) -> Iterator[dict]:
        for _, part in _runs(batches, 1 << 62, 2_048):
            if kept := _alike(part, similarity):
                yield {"a": [min(x) for x in kept], "b": [max(x) for x in kept]}

    schema = "row boolean, mask int, a bigint, b bigint"
    found = written(_map_arrays(met(nodes), nearest, schema), "found")
    pairs = written(found.where("not row").select("a", "b").distinct(), "pairs")
    links = written(_verified(docs, nodes, pairs, size, similarity), "links")
    so_far = written(joined(links).select("text_key", "least", "root", "n", "fp0", "fp1", "bands"), "so_far")
    touched = pairs.select(F.col("a").alias("text_key")).unionByName(pairs.select(F.col("b").alias("text_key"))).distinct()
    more = written(_map_arrays(met(so_far.join(touched, "text_key", "left_semi"), "root"), others, schema), "more")
    rest = written(more.where("not row").select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti"), "rest")
    rows = found.unionByName(more).where("row").select("mask", F.col("b").alias("bits"), F.col("a").alias("text_key"))
    cells = written(_cells(rows.join(so_far.select("text_key", "root", "n", "fp0", "fp1", "bands", distance), "text_key")), "cells")
    sets = written(_sets(docs, nodes, cells.select("text_key").distinct(), size), "sets")
    full = cells.join(sets, "text_key").repartition("mask", "bits").sortWithinPartitions("mask", "bits", "d")
    close = links.unionByName(_verified(docs, nodes, rest, size, similarity)).unionByName(_map_arrays(full, within, "a bigint, b bigint"))
    rooted = joined(close).select("text_key", "least", "root")
    for old in (found, pairs, links, so_far, more, rest, cells, sets):
        forget(old)
    keepers = rooted.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("n"), "least", "text_key")).alias("k"))
    rooted = rooted.join(keepers, "root").select("text_key", F.col("root").alias("group"), F.col("k.least").alias("kl"), F.col("k.text_key").alias("kt"))
    return own.select("doc_id", "text_key").join(rooted, "text_key").select("doc_id", "text_key", "group", (F.col("doc_id").eqNullSafe(F.col("kl")) & (F.col("text_key") == F.col("kt"))).alias("keeper"))


def _comparison(part: dict, similarity: float):
    """A function of index arrays (i, j): those pairs that pivot tables, popcount and the sizes of the sets let through, and their bits apart."""
    import numpy as np

    fp, fp2, n, ref = part["fp0"].astype("i8").view("u8"), part["fp1"].astype("i8").view("u8"), part["n"].astype("i8"), pivots(4)
    table = np.bitwise_count(fp[:, None] ^ ref[None, :2]).astype("i2") + np.bitwise_count(fp2[:, None] ^ ref[None, 2:])

    def close(i, j):
        near = np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9
        i, j = i[near], j[near]
        near = np.abs(table[i] - table[j]).max(axis=1, initial=0) <= MOST_BITS
        i, j = i[near], j[near]
        bits = np.bitwise_count(fp[i] ^ fp[j]).astype("i4") + np.bitwise_count(fp2[i] ^ fp2[j])
        near = bits <= MOST_BITS
        return i[near], j[near], bits[near].astype("i4")

    return close


def _spanning(part: dict, similarity: float) -> tuple:
    """(i, j) index arrays of pairs that connect, run by run, what the neighbours that _comparison lets through connect. Boruvka's rounds: for each part that is
    connected so far, its nearest pair with a row outside of it (ties: the least keys). Rows without such a pair and runs that are one part leave."""
    import numpy as np

    at, label, out_i, out_j = np.arange(len(part["mask"])), np.arange(len(part["mask"])), [], []
    while len(at):
        now = {k: part[k][at] for k in ("mask", "bits", "d", "n", "fp0", "fp1")}
        key, own, close = part["text_key"][at].astype("i8"), label[at], _comparison(now, similarity)
        nearest, partner = np.full(len(at), MOST_BITS + 1, "i4"), np.zeros(len(at), "i8")
        for i, j in _neighbours(now, MOST_BITS, NEIGHBOURS):
            apart = own[i] != own[j]
            i, j, bits = close(i[apart], j[apart])
            for x, y in ((j, i), (i, j)):
                better = (bits < nearest[x]) | (bits == nearest[x]) & (bits <= MOST_BITS) & (key[y] < key[partner[x]])
                nearest[x[better]], partner[x[better]] = bits[better], y[better]
        found = np.flatnonzero(nearest <= MOST_BITS)
        if not len(found):
            break
        other = partner[found]
        order = np.lexsort((np.maximum(key[found], key[other]), np.minimum(key[found], key[other]), nearest[found], own[found]))
        first = order[np.append(True, own[found][order][1:] != own[found][order][:-1])]
        i, j = at[found[first]], at[other[first]]
        out_i.append(i)
        out_j.append(j)
        label = _merged(label, i, j)
        if len(out_i) == 1:
            at = at[found]  # a row with no neighbour at first has none later
        starts = _starts({k: part[k][at] for k in ("mask", "bits")})
        several = np.minimum.reduceat(label[at], starts) != np.maximum.reduceat(label[at], starts)
        at = at[np.repeat(several, np.diff(np.append(starts, len(at))))]
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (np.zeros(0, "i8"), np.zeros(0, "i8"))


def _cells(rows: DataFrame) -> DataFrame:
    """The rows of runs with more than one root, each run cut into blocks of about BLOCK shingles or BLOCK_ROWS texts and every two blocks put together as a run of their own
    (bits: a hash of the old ones and both blocks), so that all pairs of a run of any length meet, and no task has the whole run."""
    runs = rows.groupBy("mask", "bits").agg(F.sum("n").alias("all"), F.count("*").alias("texts"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    dealt = rows.join(runs.select("mask", "bits", F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("all") / BLOCK), F.ceil(F.col("texts") / BLOCK_ROWS)).alias("blocks")), ["mask", "bits"])
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("text_key"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    cell = F.xxhash64("bits", F.least("own", "other"), F.greatest("own", "other"))
    return dealt.select("mask", cell.alias("bits"), "d", "text_key", "root", "n", "fp0", "fp1", "bands")


def _divided(part: dict) -> dict:
    """The rows of runs with more than one root."""
    import numpy as np

    starts = _starts(part)
    several = np.minimum.reduceat(part["root"], starts) != np.maximum.reduceat(part["root"], starts)
    several = np.repeat(several, np.diff(np.append(starts, len(part["mask"]))))
    return {k: v[several] for k, v in part.items()}


def _across(part: dict, similarity: float) -> Iterator[tuple]:
    """(i, j) index arrays of all pairs of a run's rows that _comparison lets through and that have different roots."""
    root = part["root"]
    if len(root):
        close = _comparison(part, similarity)
        for i, j in _neighbours(part, MOST_BITS, len(root)):
            apart = root[i] != root[j]
            i, j, _ = close(i[apart], j[apart])
            yield i, j


def _alike(part: dict, similarity: float, pairs: int = 8_192, columns: int = 16_384) -> list[tuple[int, int]]:
    """Links (a forest of text keys) between rows of different roots, of the same run, whose shingle sets are similar enough. A pair is compared in the
    first of the bands that it has in common, and not once it is joined by others. Sets are bit rows over the shingles that several rows have, some columns at a time."""
    import numpy as np

    key, bands, sets = part["text_key"].astype("i8"), np.array([np.asarray(x, "i8") for x in part["bands"]]), [np.frombuffer(x, "u8") for x in part["set"]]
    sizes = np.array([len(x) for x in sets])
    row = np.repeat(np.arange(len(sets)), sizes)
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts[column] > 1
    place = np.cumsum(counts > 1) - 1
    row, column = row[shared], place[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    edges = np.searchsorted(column, np.arange(0, int(column[-1]) + 1 + columns, columns)) if len(column) else np.zeros(1, "i8")
    label, kept = part["root"].astype("i8").copy(), []

    def verify(i, j) -> None:
        nonlocal label
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
        both = np.zeros(len(i), "i8")
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            bits = np.zeros((len(sets), columns), bool)
            bits[row[a:b], column[a:b] - k * columns] = True
            packed = np.packbits(bits, axis=1).view("u8")
            for at in range(0, len(i), 1_024):
                own = slice(at, at + 1_024)
                both[own] += np.bitwise_count(packed[i[own]] & packed[j[own]]).sum(axis=1, dtype="i8")
        either = sizes[i] + sizes[j] - both
        for x, y in zip(i[both >= similarity * either].tolist(), j[both >= similarity * either].tolist(), strict=True):
            if label[x] != label[y]:
                kept.append((int(key[x]), int(key[y])))
                label[label == label[y]] = label[x]

    some, n = [], 0
    for i, j in _across(part, similarity):
        same = bands[i] == bands[j]
        first = same.argmax(axis=1) == part["mask"][i]
        some.append((i[first], j[first]))
        n += int(first.sum())
        if n >= pairs:
            verify(*(np.concatenate(x) for x in zip(*some, strict=True)))
            some, n = [], 0
    if n:
        verify(*(np.concatenate(x) for x in zip(*some, strict=True)))
    return kept


def _ordered(key, found, rows: int = 1 << 18) -> Iterator[dict]:
    """The pairs of keys, the lesser as a, of (i, j) index arrays; repeats are left out within some `rows` pairs."""
    import numpy as np

    some, n = [], 0
    for i, j in found:
        if len(i):
            some.append(np.stack([np.minimum(key[i], key[j]), np.maximum(key[i], key[j])], axis=1))
            n += len(i)
        if n >= rows:
            both = np.unique(np.concatenate(some), axis=0)
            yield {"a": both[:, 0], "b": both[:, 1]}
            some, n = [], 0
    if n:
        both = np.unique(np.concatenate(some), axis=0)
        yield {"a": both[:, 0], "b": both[:, 1]}


def _merged(label, a, b):
    """label (each row's least connected row) after the links a, b."""
    import numpy as np

    label = label.copy()
    while (label[a] != label[b]).any():
        x, y = label[a], label[b]
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label[label] != label).any():
            label = label[label]
    return label


def _least(h, factors):
    """The min-hashes of a set of hashes: for each factor the least of the mixed products; the largest number for the empty set."""
    import numpy as np

    out = np.full(len(factors), 2**64 - 1, "u8")
    for at in range(0, len(h), 2_048):
        x = h[at : at + 2_048, None] * factors[None, :]
        np.minimum(out, (x ^ (x >> np.uint64(31))).min(axis=0), out=out)
    return out


def _map_words(docs: DataFrame, size: int, similarity: float) -> DataFrame:
    count = bands(similarity)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        import numpy as np

        odd = np.random.default_rng(SEED + 2).integers(0, 2**63, 2 + count * BAND + BAND, "u8") * np.uint64(2) + np.uint64(1)
        mixers, factors, folds = odd[:2], odd[2 : 2 + count * BAND], odd[2 + count * BAND :]
        for b in batches:
            fps, own, sizes = [], [], []
            for t in b["text"]:
                h = np.unique(hashes(t, size))  # each shingle once, as the similarity counts them
                sizes.append(len(h))
                h ^= h >> np.uint64(29)
                mixed = (h * m for m in mixers)
                fps.append([simhash(x ^ (x >> np.uint64(32))) for x in mixed])
                least = _least(h, factors).reshape(count, BAND)
                least ^= least >> np.uint64(32)
                own.append((least * folds[None, :]).sum(axis=1, dtype="u8").view("i8"))
            yield {"doc_id": b["doc_id"], "text_key": b["text_key"], "n": sizes, "fp0": [x[0] for x in fps], "fp1": [x[1] for x in fps], "bands": own}

    return map_columns(docs, run, "doc_id bigint, text_key bigint, n bigint, fp0 bigint, fp1 bigint, bands array<bigint>")


def _sets(docs: DataFrame, nodes: DataFrame, keys: DataFrame, size: int) -> DataFrame:
    """text_key, set (the sorted hashes of the distinct shingles) of the texts with these keys; only those are read again."""
    import numpy as np

    wanted = keys.join(nodes.select("text_key", "least"), "text_key").select(F.col("text_key").alias("k"), "least")
    texts = docs.join(wanted, docs["doc_id"].eqNullSafe(F.col("least")) & (docs["text_key"] == F.col("k")), "left_semi")

    def sets(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            yield {"text_key": b["text_key"], "set": [np.unique(hashes(t, size)).astype("u8").tobytes() for t in b["text"]]}

    return map_columns(texts.select("text_key", "text"), sets, "text_key bigint, set binary").dropDuplicates(["text_key"])


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of text keys whose shingle sets are similar enough."""
    import numpy as np

    keys = pairs.select(F.col("a").alias("text_key")).unionByName(pairs.select(F.col("b").alias("text_key"))).distinct()
    known = written(_sets(docs, nodes, keys, size), "sets")

    def compare(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            same = []
            for x, y in zip(b["x"], b["y"], strict=True):
                p, q = np.frombuffer(x, "u8"), np.frombuffer(y, "u8")
                both = len(np.intersect1d(p, q, assume_unique=True))
                either = len(p) + len(q) - both
                same.append(not either or both >= similarity * either)
            yield {"a": [v for v, s in zip(b["a"], same, strict=True) if s], "b": [v for v, s in zip(b["b"], same, strict=True) if s]}

    left = pairs.join(known.select(F.col("text_key").alias("a"), F.col("set").alias("x")), "a")
    both = left.join(known.select(F.col("text_key").alias("b"), F.col("set").alias("y")), "b")
    return map_columns(both.select("a", "b", "x", "y"), compare, "a bigint, b bigint")


def keep_one(docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each near-duplicate group: the smallest doc_id's (nulls last); of rows that repeat it, one."""
    own, clashes = keyed(docs)
    kept = written(_groups(own, size, similarity).where("keeper").groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).select("doc_id", "text_key", "n"), "kept")
    repeated = not kept.where("n > 1").isEmpty()
    kept = kept.select(F.col("doc_id").alias("_kept_id"), F.col("text_key").alias("_kept_key"))
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), _key(F.coalesce("text", F.lit("")), clashes).alias("_key"))
    out = rows.join(kept, rows["_id"].eqNullSafe(F.col("_kept_id")) & (rows["_key"] == F.col("_kept_key")), "left_semi")
    return (out.dropDuplicates(["_id", "_key"]) if repeated else out).select("_row.*")
