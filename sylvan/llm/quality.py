"""Quality by a factorisation machine over hashed words, structure statistics and metadata.

score = 1 / (1 + exp(-y)), y = w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2): all pairwise interactions of rank RANK in time
linear in a text's distinct words (the sum-of-squares identity).

Inputs x: BUCKETS hashed words (log counts, of unit length), STATISTICS of the text's structure and, as metadata, its length. Labels, lang, source and
doc_id are never inputs. It is trained on TRAIN_ROWS labelled rows and TRAIN_BYTES of their features at most, chosen by a hash of doc_id; every text is scored whole.

Null text counts as empty (only the bias and the statistics speak). Rows without a label or with a null one aren't trained on; of several labels of
one doc_id the least counts, of several texts the first in order. Without any labelled row, or with one class only, the score is that class's smoothed share. Repeated rows score alike; other columns are kept, and the score is called by the name asked for, with underscores after it while there is a column of that name;
an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, free_name, map_columns, small_batches, written

BUCKETS = 1 << 15
RANK = 8
TRAIN_ROWS = 8_000
TRAIN_BYTES = 128 << 20
#: Passes over the training rows: EPOCHS, or as many as make STEPS batches.
EPOCHS = 10
STEPS = 1_000
BATCH = 128
RATE = 0.02
DECAY = 1e-5
SEED = 7
THRESHOLD = 0.3
#: Entries of a worker's memo from words to buckets.
MEMO = 150_000

STATISTICS = (
    "log_chars", "log_words", "mean_word", "upper", "digit", "punctuation", "space", "other_ascii", "capital_words", "distinct_words", "top_word", "distinct_pairs", "log_lines", "repeated_lines",
    "word_with_symbol", "long_words", "one_letter_words", "stops",
)
_memo: dict[str, int] = {}
_classes = None


def _classify():
    """A class for each code point under 256: 1 upper, 2 digit, 3 ordinary punctuation, 4 space, 5 other ASCII sign; 0 any other."""
    global _classes
    if _classes is None:
        import numpy as np

        _classes = np.zeros(257, "u1")
        for c in range(256):
            x = chr(c)
            _classes[c] = 1 if x.isupper() else 2 if x.isdigit() and c < 128 else 3 if x in ".,;:'\"()-?!" else 4 if x.isspace() else 5 if c < 128 and not x.isalnum() and c > 32 else 0
    return _classes


def features(text: str | None) -> tuple[list[float], list[int], list[float]]:
    """The structure statistics, and the buckets and weights of the words."""
    import numpy as np

    text = text or ""
    if len(_memo) > MEMO:
        _memo.clear()
    codes = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), 256)
    kinds = np.bincount(_classify()[codes], minlength=6) / max(1, len(text))
    words = text.split()
    n = max(1, len(words))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x]
    pairs = len(set(zip(words, words[1:], strict=False)))
    stats = [
        np.log1p(len(text)), np.log1p(len(words)), min(len(text) / n, 60) / 10, *kinds[1:6],
        sum(c for w, c in counts.items() if w[0].isupper()) / n, len(counts) / n, max(counts.values(), default=0) / n, pairs / n, np.log1p(len(lines)), 1 - len(set(lines)) / max(1, len(lines)),
        sum(c for w, c in counts.items() if not (w[-1].isalnum() or w[-1] in ".,;:!?)'\"")) / n, sum(c for w, c in counts.items() if len(w) > 20) / n, sum(c for w, c in counts.items() if len(w) == 1) / n,
        sum(c for w, c in counts.items() if w[-1] == ".") / n,
    ]
    by: dict[int, int] = {}
    for w, c in counts.items():
        b = _memo.get(w)
        if b is None:
            b = _memo[w] = zlib.crc32(w.lower().strip(".,;:!?()'\"").encode("utf-8", "surrogatepass")) % BUCKETS
        by[b] = by.get(b, 0) + c
    weight = np.log1p(np.fromiter(by.values(), "f8", len(by)))
    weight /= max(1e-9, float(np.sqrt((weight**2).sum())))
    return [float(x) for x in stats], list(by), weight.tolist()


@dataclass
class Machine:
    """The trained model: arrays over the BUCKETS words, then the statistics."""

    bias: float
    linear: object
    factors: object
    mean: object
    scale: object

    def scores(self, rows: list[tuple[list[float], list[int], list[float]]]):
        import numpy as np

        y, _, _ = _forward(self.bias, self.linear, self.factors, *_batch(rows, self.mean, self.scale))
        return 1 / (1 + np.exp(-np.clip(y, -30, 30)))


def _batch(rows, mean, scale):
    """(at, x, sizes, stats): the words' buckets and values row after row, how many each row has, and the matrix of scaled statistics."""
    import numpy as np

    stats = np.clip((np.array([r[0] for r in rows]) - mean) / scale, -5, 5) / 4
    sizes = np.array([len(r[1]) for r in rows])
    return np.concatenate([np.asarray(r[1], "u2") for r in rows]), np.concatenate([np.asarray(r[2], "f8") for r in rows]), sizes, stats


def _row_sums(values, sizes):
    """Sums of each row's values, which lie row after row; rows may be empty."""
    import numpy as np

    out, some = np.zeros((len(sizes), *values.shape[1:])), sizes > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[some], axis=0)
    return out


def _forward(bias, linear, factors, at, x, sizes, stats):
    """(y, v, sums): the machine's output, the words' factors times their values, and the sums of these over all inputs of a row."""
    import numpy as np

    v = factors.take(at, axis=0)
    v *= x[:, None]
    sums = _row_sums(v, sizes) + stats @ factors[BUCKETS:]
    squares = _row_sums(np.einsum("ij,ij->i", v, v), sizes) + stats**2 @ (factors[BUCKETS:] ** 2).sum(axis=1)
    return bias + _row_sums(linear[at] * x, sizes) + stats @ linear[BUCKETS:] + 0.5 * ((sums**2).sum(axis=1) - squares), v, sums


def fit(rows: list[tuple[list[float], list[int], list[float]]], labels: list[int]) -> Machine:
    """Adagrad on the log loss; the same rows give the same model."""
    import numpy as np

    size = BUCKETS + len(STATISTICS)
    rng = np.random.default_rng(SEED)
    share = (sum(labels) + 1) / (len(labels) + 2)
    bias, linear, factors = float(np.log(share / (1 - share))), np.zeros(size), rng.normal(0, 0.02, (size, RANK))
    if len(set(labels)) < 2:
        return Machine(bias, linear, np.zeros((size, RANK)), np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)))
    stats = np.array([r[0] for r in rows])
    mean, scale = stats.mean(axis=0), stats.std(axis=0) + 1e-3
    target = np.array(labels, "f8")
    g_linear, g_factors, g_bias = np.full(size, 1e-2), np.full((size, RANK), 1e-2), 1e-2
    for _ in range(max(EPOCHS, -(-STEPS * BATCH // len(rows)))):
        order = rng.permutation(len(rows))
        for a in range(0, len(rows), BATCH):
            own = order[a : a + BATCH]
            at, x, sizes, stats = _batch([rows[i] for i in own], mean, scale)
            y, v, sums = _forward(bias, linear, factors, at, x, sizes, stats)
            error = (1 / (1 + np.exp(-np.clip(y, -30, 30))) - target[own]) / len(own) * BATCH / 8
            by_word = np.argsort(at, kind="stable")
            used = at[by_word]
            starts = np.flatnonzero(np.append(True, used[1:] != used[:-1])) if len(used) else np.zeros(0, "i8")
            ex = np.repeat(error, sizes) * x
            inner = sums.take(np.repeat(np.arange(len(own)), sizes), axis=0)
            inner -= v
            inner *= ex[:, None]
            # of the words in this batch, then of the statistics
            places = np.concatenate([used[starts].astype("i8"), np.arange(BUCKETS, size)])
            words = (np.add.reduceat(ex[by_word], starts), np.add.reduceat(inner.take(by_word, axis=0), starts, axis=0)) if len(used) else (np.zeros(0), np.zeros((0, RANK)))
            own_factors = stats.T @ (error[:, None] * sums) - (stats**2).T @ error[:, None] * factors[BUCKETS:]
            d_linear = np.concatenate([words[0], stats.T @ error]) + DECAY * linear[places]
            d_factors = np.concatenate([words[1], own_factors]) + DECAY * factors[places]
            g_linear[places] += d_linear**2
            g_factors[places] += d_factors**2
            g_bias += error.sum() ** 2
            linear[places] -= 5 * RATE * d_linear / np.sqrt(g_linear[places])
            factors[places] -= RATE * d_factors / np.sqrt(g_factors[places])
            bias -= RATE * error.sum() / np.sqrt(g_bias)
    return Machine(bias, linear.astype("f4"), factors.astype("f4"), mean, scale)


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: crc32 of its id's digits is divisible by five."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> Machine:
    """A machine from labels (doc_id, quality) outside the held-out fold: the first rows by a hash of doc_id, `most` and most_bytes of features at most."""
    import numpy as np

    small_batches(docs.sparkSession)
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    order = F.xxhash64("doc_id").alias("place")
    chosen = known.orderBy(order, "doc_id").limit(most)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        import numpy as np

        for b in batches:
            rows = [features(t) for t in b["text"]]
            at, x = [np.array(r[1], "i4").tobytes() for r in rows], [np.array(r[2], "f4").tobytes() for r in rows]
            yield {"doc_id": b["doc_id"], "label": b["label"], "bytes": [200 + len(a) + len(c) for a, c in zip(at, x, strict=True)], "stats": [r[0] for r in rows], "at": at, "x": x}

    # at most `most` ids: the bound holds for the broadcast side, and one text an id for what is learnt from
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    table = written(map_columns(texts, run, "doc_id bigint, label int, bytes bigint, stats array<double>, at binary, x binary"), "features")
    taken, total = [], 0
    for r in table.select("doc_id", "bytes", order).orderBy("place", "doc_id").collect():
        total += r["bytes"]
        if total > most_bytes:
            break
        taken.append(r["doc_id"])
    got = table.where(F.col("doc_id").isin(taken)).collect() if total > most_bytes else table.collect()
    forget(table)
    got.sort(key=lambda r: r["doc_id"])
    return fit([(r["stats"], np.frombuffer(r["at"], "i4"), np.frombuffer(r["x"], "f4")) for r in got], [r["label"] for r in got])


def with_score(docs: DataFrame, machine: Machine, name: str = "score") -> DataFrame:
    """docs with a score for each whole text."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores([features(t) for t in texts])) if len(texts) else pd.Series([], dtype="float64")

    return docs.withColumn(free_name(docs, name), score(F.col("text")))


def predicted(score: Column, threshold: float = THRESHOLD) -> Column:
    return F.when(score >= threshold, 1).otherwise(0)
