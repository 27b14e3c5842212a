"""Document fingerprints from closed syncmers, in DataFrame functions only.

A text's words (split at space and \\x09-\\x0D, lower case) are hashed; K_WORDS words in a row, padded at both ends, are a k-mer. A k-mer is an anchor
if, of its inner runs of S_WORDS words, one of least hash lies at its left or right edge. That depends on the k-mer alone, not on its
neighbours, so an edit moves only the anchors whose k-mers it touches and all others stay comparable by position.
The fingerprint is the anchors' 32-bit hashes in text order, eight hex digits each.

Two fingerprints are compared by position: anchors that both have are matched (each by its first place), and a match counts if it shifts that place by about as much as the
median match does (SLACK of the longer fingerprint); so a text moved as a whole is alike, and one whose halves have changed places is not.

Null text counts as empty. An empty text has no anchor and the empty fingerprint; two of them have likeness 1, one of them and any other 0.
The padding gives any non-empty text at least one k-mer, so short texts compare too. Rows of one doc_id, or of none, are ordered by a hash of their text. Columns other than doc_id and
text are ignored; an empty table gives an empty result. Texts of any length are read whole.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K_WORDS = 5
S_WORDS = 2
#: By how much of the longer fingerprint a match may lie off the median shift (and by LEAST_SLACK places in any case).
SLACK = 0.125
LEAST_SLACK = 8
#: Parts into which a bucket is cut whose doc_id (or null) alone has more rows than a bucket should.
PARTS = 64
#: Buckets of the ordering: this many for each shuffle partition, and never more than MOST_BUCKETS (the bounds are a literal in the plan).
BUCKETS_PER_PARTITION = 3
MOST_BUCKETS = 4096


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once, however often the body's lambdas use it."""
    return F.transform(F.array(value), body)[0]


def anchors(text: Column) -> Column:
    """The hashes (array<int>) of the closed syncmers, in text order."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")
    pad = lambda seed: F.transform(F.sequence(F.lit(1), F.lit(K_WORDS - 1)), lambda i: F.hash(F.lit(seed), i))
    padded = F.concat(pad("front"), F.transform(words, lambda w: F.hash(w)), pad("rear"))
    last = K_WORDS - S_WORDS  # place of the right edge's inner run

    def selected(h: Column) -> Column:
        n = F.size(h)
        inner = F.transform(F.sequence(F.lit(0), n - S_WORDS), lambda i: F.hash(F.get(h, i), F.get(h, i + 1)))

        def kept(m: Column) -> Column:
            at = F.filter(F.sequence(F.lit(0), n - K_WORDS), lambda i: F.least(F.get(m, i), F.get(m, i + last)) <= F.least(*(F.get(m, i + j) for j in range(1, last))))
            return F.transform(at, lambda i: F.hash(F.get(m, i), F.get(m, i + 2), F.get(h, i + 4)))

        return _let(inner, kept)

    return _let(padded, lambda h: F.when(F.size(h) > 2 * (K_WORDS - 1), selected(h)).otherwise(F.array().cast("array<int>")))


def fingerprint(hashes: Column) -> Column:
    """The anchors as text: eight lower-case hex digits each."""
    return F.lower(F.array_join(F.transform(hashes, lambda a: F.substring(F.hex(a.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.lit(1 << 32))), 2, 8)), ""))


def likeness(a: Column, b: Column) -> Column:
    """Distinct anchors matched in place over all distinct anchors; 1 if both are empty."""

    def placed(x: Column, side: int) -> Column:
        """An anchor's hash, the side and the place in one number, so that sorting puts equal anchors side by side."""
        return F.transform(x, lambda h, i: F.shiftleft(h.cast("bigint"), 32).bitwiseOR(F.lit(side << 31)).bitwiseOR(i.cast("bigint")))

    def compared(x: Column) -> Column:
        na, nb = F.size(x["a"]), F.size(x["b"])
        place = lambda v: v.bitwiseAND(F.lit((1 << 31) - 1))

        def shifts(s: Column) -> Column:
            both = F.filter(F.sequence(F.lit(0), F.size(s) - 2), lambda i: F.shiftright(F.get(s, i), 32) == F.shiftright(F.get(s, i + 1), 32))
            return F.array_sort(F.transform(both, lambda i: place(F.get(s, i + 1)) - place(F.get(s, i))))

        def share(d: Column) -> Column:
            slack, middle = F.greatest(F.lit(LEAST_SLACK), F.floor(F.greatest(na, nb) * SLACK)), F.get(d, F.floor(F.size(d) / 2).cast("int"))
            near = F.size(F.filter(d, lambda v: F.abs(v - middle) <= slack))
            return near / (na + nb - near)

        some = _let(_let(F.sort_array(F.concat(placed(x["a"], 0), placed(x["b"], 1))), shifts), share)
        return F.when((na == 0) & (nb == 0), F.lit(1.0)).when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(some)

    return _let(F.struct(F.array_distinct(a).alias("a"), F.array_distinct(b).alias("b")), compared)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text: the text after it in descending doc_id (nulls last; equal ids by a hash of the text), after the last the first.

    doc_id's quantiles cut the order into even buckets, a doc_id that is several of them and the nulls into PARTS by the hash, and each bucket also gets a copy of the next
    bucket's first row; so no task holds more than a bucket, and only the buckets' first rows' keys (one each) go to the driver.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = min(MOST_BUCKETS, BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")))
    quantiles = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n)).first()[0] or []
    cuts, hot = sorted(set(quantiles)), sorted({q for q in quantiles if quantiles.count(q) > 1})
    tie = F.xxhash64("text")
    part = F.shiftright(tie, 64 - PARTS.bit_length() + 1) + PARTS // 2  # by the hash's first bits, in its order
    alone = F.col("doc_id").isNull() | F.col("doc_id").isin(hot) if hot else F.col("doc_id").isNull()
    literal = lambda values: F.from_json(F.lit(json.dumps(values)), "array<bigint>")
    above = F.when(F.col("doc_id").isNull(), len(cuts)).otherwise(F.size(F.filter(literal(cuts), lambda c: c > F.col("doc_id")))).cast("int")
    # a hot doc_id is a quantile, the least doc_id of its bucket, and nulls are last of all: their parts come after a bucket's other rows
    placed = docs.withColumn("tie", tie).withColumn("_bucket", above * (PARTS + 1) + F.when(alone, part.cast("int") + 1).otherwise(0))
    heads = placed.groupBy("_bucket").agg(F.min(F.struct((-F.coalesce("doc_id", F.lit(0).cast("bigint"))).alias("o"), "tie")).alias("m")).orderBy("_bucket").select("_bucket", "m.*").collect()
    order = {r["_bucket"]: i for i, r in enumerate(heads)}
    at = F.array_position(literal(list(order)), F.col("_bucket").cast("bigint")).cast("int") - 1
    placed = placed.withColumn("at", at)
    is_head = (-F.coalesce("doc_id", F.lit(0).cast("bigint")) == F.get(literal([r["o"] for r in heads]), F.col("at"))) & (F.col("tie") == F.get(literal([r["tie"] for r in heads]), F.col("at")))
    own = F.struct(F.col("at").alias("b"), F.lit(False).alias("copy"))
    copy = F.struct(F.pmod(F.col("at") - 1, F.lit(max(1, len(heads)))).alias("b"), F.lit(True).alias("copy"))  # the first row of all goes to the last bucket
    rows = placed.select("doc_id", "text", "tie", F.explode(F.when(is_head, F.array(own, copy)).otherwise(F.array(own))).alias("p")).select("doc_id", "text", "tie", "p.b", "p.copy")
    return rows.withColumn("next_text", F.lead("text").over(_order()))


def _order():
    return Window.partitionBy("b").orderBy("copy", F.col("doc_id").desc_nulls_last(), "tie")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, anchors of every row's whole text."""
    return docs.select("doc_id", anchors(F.col("text")).alias("anchors"))


def edit_likeness(docs: DataFrame) -> DataFrame:
    """op1's contract: each text's fingerprint, that of its edited text, and how like it is to that and to the next document's."""
    rows = with_next(docs)
    n = F.char_length("text")
    edited = F.concat(F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 3) as int))"), F.expr("substring(next_text, 1, cast(floor(char_length(text) / 3) as int))"))
    rows = rows.select("doc_id", "b", "copy", "tie", "text", n.cast("bigint").alias("n_chars"), edited.alias("edited"))
    rows = rows.select("doc_id", "b", "copy", "tie", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), anchors(F.col("text")).alias("own"), anchors(F.col("edited")).alias("changed"))
    rows = rows.withColumn("next", F.lead("own").over(_order())).where("not copy")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
