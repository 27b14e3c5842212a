"""Secret scans, in DataFrame functions only: three patterns, and two character Markov models compared by log-likelihood ratio.

Base kinds, leftmost and not overlapping within a kind; a span is the whole match, in code points, end exclusive:
assign (a name such as password, `=` or `:`, a value of 6+ characters), access (AKIA and capitals or digits, 20+), hex (24+ of 0-9a-f).

The method's own kind, markov: a run of 16+ characters of an identifier or base64 alphabet that is likelier as a random string than as an ordinary
identifier. Both models are first-order over characters, trained from labelled samples: random strings drawn evenly from the usual alphabets
by a fixed seed, and ordinary identifiers put together from common words in the usual styles. A run counts if some stretch of 16+ characters in it has a
mean ratio of LIMIT nats a character or more (so an ordinary prefix hides nothing), it has a letter, and no base span overlaps or adjoins it; the span is the whole run.

Null text counts as empty; empty texts and repeated rows each have their row; texts are read whole; other columns than doc_id and text are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
import random
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the base kinds, and the least length of what they find.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
STRETCH = 16
#: A sign that stands for each character of a base span while runs are looked for (where a text has it itself, it counts as a space).
MARK = "\ue000"
RUN_SIGNS = "A-Za-z0-9+/_-"

KINDS = ("assign", "access", "hex", "markov")
LIMIT = 0.6
ALPHABET = string.ascii_lowercase + string.ascii_uppercase + string.digits + "+/_-="

# Words of which ordinary identifiers are made.
WORDS = (
    "account action active address agent alert amount answer app array auth author backup base batch billing block body branch buffer build button bytes cache call card "
    "category channel chart check class click client cluster code column comment commit common config connection content context control cookie copy count country create "
    "current customer data database date debug default delete detail device dialog directory display document domain download driver edit element email enable encoding end "
    "entity entry error event example export factory field file filter final first flag folder form format frame function gateway global graph group handler hash header height "
    "history home host icon identifier image import index info initial input instance integer interface internal invoice item job key label language last layout length level "
    "library limit line link list loader local location lock log login main manager map master match max memory menu message method metric min mode model module monitor name "
    "network next node note number object offset option order output owner package page panel param parent parser partition password path payment period permission phone "
    "platform player plugin point policy port position post price printer priority process product profile program project property provider public query queue random range "
    "record region register release remote render report request resource response result return role root route row rule schedule schema scope screen script search section "
    "security select sender sequence server service session setting shape share shipping size source stack start state static status step storage store stream string style "
    "subject submit summary support system table target task template test text theme thread time timeout title token tool total trace transaction transfer tree trigger type "
    "unit update upload url user utils valid value vector vendor version video view visible volume warning web widget width window worker wrapper write zone"
).split()


def samples(n: int = 4_000, seed: int = 1) -> list[tuple[str, int]]:
    """(string, label): 1 random, 0 an ordinary identifier or word."""
    rng = random.Random(seed)
    alphabets = [string.hexdigits[:16], string.hexdigits[:16].upper(), string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits, string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"]
    out = []
    for i in range(n):
        alphabet = alphabets[i % len(alphabets)]
        out.append(("".join(rng.choice(alphabet) for _ in range(rng.randint(20, 44))), 1))
        words = [rng.choice(WORDS) for _ in range(rng.randint(2, 5))]
        number = str(rng.randint(1, 2030)) if rng.random() < 0.4 else ""
        style = i % 5
        if style == 0:
            name = "_".join(words) + "_" * bool(number) + number
        elif style == 1:
            name = words[0] + "".join(w.title() for w in words[1:]) + number
        elif style == 2:
            name = "".join(w.title() for w in words) + number
        elif style == 3:
            name = "-".join(words) + "-" * bool(number) + number
        else:
            name = "_".join(words).upper() + "_" * bool(number) + number
        if rng.random() < 0.15:
            name = "/".join([name, *(rng.choice(WORDS) for _ in range(2))])
        out.append((name, 0))
    return out


def ratios(labelled: list[tuple[str, int]]) -> list[float]:
    """log P(random) - log P(ordinary) of each pair of characters, as a flat square table over ALPHABET and one place for any other."""
    n = len(ALPHABET) + 1
    place = {c: i for i, c in enumerate(ALPHABET)}
    counts = [[[0.5] * n for _ in range(n)] for _ in range(2)]
    for text, label in labelled:
        at = [place.get(c, n - 1) for c in text]
        for a, b in zip(at, at[1:], strict=False):
            counts[label][a][b] += 1
    logs = [[[math.log(x / sum(row)) for x in row] for row in model] for model in counts]
    return [logs[1][a][b] - logs[0][a][b] for a in range(n) for b in range(n)]


def _places(run: Column) -> Column:
    """array<int>: each character's place in the table (other ones: the last)."""
    n = len(ALPHABET)
    by_code = F.lit([ALPHABET.find(chr(c)) if chr(c) in ALPHABET else n for c in range(128)])
    return F.transform(F.split(run, ""), lambda c: F.coalesce(F.get(by_code, F.ascii(c)), F.lit(n)))


def _ratios_of(run: Column, table: list[float], less: float = 0.0) -> Column:
    """array<double>: the ratio of each pair of neighbours, less a number."""
    n = len(ALPHABET) + 1
    pairs = lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - 2), lambda i: F.get(F.lit(table), F.get(c, i) * n + F.get(c, i + 1)) - less)
    return F.transform(F.array(_places(run)), pairs)[0]


def likelihood_ratio(run: Column, table: list[float]) -> Column:
    """Mean nats a character pair by which run is likelier as a random string."""
    return F.transform(F.array(_ratios_of(run, table)), lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x))[0]


def random_stretch(run: Column, table: list[float], limit: float) -> Column:
    """Whether some stretch of STRETCH or more characters of run has a mean ratio of limit or more: over the sums less limit a pair, the last one against
    the least of those that lie STRETCH - 1 pairs back or more."""
    lag = STRETCH - 1

    def best(x: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            now = acc["now"] + F.get(x, i)
            back = acc["back"] + F.when(i >= lag, F.get(x, i - lag)).otherwise(0.0)
            least = F.least(acc["least"], back)
            most = F.when(i >= lag - 1, F.greatest(acc["most"], now - least)).otherwise(acc["most"])
            return F.struct(now.alias("now"), back.alias("back"), least.alias("least"), most.alias("most"))

        zero = F.struct(F.lit(0.0).alias("now"), F.lit(0.0).alias("back"), F.lit(0.0).alias("least"), F.lit(float("-inf")).alias("most"))
        return F.aggregate(F.sequence(F.lit(0), F.size(x) - 1), zero, step, lambda acc: acc["most"] >= 0)

    return F.transform(F.array(_ratios_of(run, table, limit)), best)[0]


def _spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of a pattern's matches (0-based, in code points): the gaps that split() leaves give the places.

    Matches are summed up in blocks of about the root of their number, and then the blocks, so that the copying in array concatenation stays under n^1.5.
    """
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    steps = F.transform(F.arrays_zip(gaps.alias("gap"), found.alias("value")), lambda x: F.struct(F.char_length(x["gap"]).alias("gap"), x["value"].alias("value")))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(_NONE).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(F.char_length(x["value"]), F.lit(0))
        one = F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))
        return F.struct(end.alias("at"), F.when(x["value"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], one)).alias("out"))

    def blocks(x: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(x))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / size).cast("int")), lambda b: F.aggregate(F.slice(x, b * size + 1, size), empty, step))

    def shifted(x: Column) -> Column:
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        starts = F.aggregate(x, none, lambda acc, b: F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")), lambda acc: acc["starts"])
        move = lambda b, at: F.transform(b["out"], lambda s: F.struct((s["start"] + at).alias("start"), (s["end"] + at).alias("end"), s["value"].alias("value")))
        return F.flatten(F.zip_with(x, starts, move))

    return F.transform(F.transform(F.array(steps), blocks), shifted)[0]


def _masked(text: Column, pattern: str, kept=None) -> Column:
    """text with MARK for each character of a pattern's matches (of those that `kept` holds for)."""
    mark = lambda v: F.repeat(F.lit(MARK), F.char_length(v))
    shown = mark if kept is None else lambda v: F.when(kept(v), mark(v)).otherwise(v)
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda g, v: F.array(g, F.coalesce(shown(v), F.lit(""))))
    return F.array_join(F.flatten(pairs), "")


_NONE = "array<struct<start:int,end:int,value:string>>"


def scan(docs: DataFrame, limit: float = LIMIT, labelled: list[tuple[str, int]] | None = None) -> DataFrame:
    """doc_id, and for each kind an array of its spans (start, end, value)."""
    none = F.array().cast(_NONE)
    text = F.col("text")
    table = ratios(samples() if labelled is None else labelled)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    low = F.lower(text)
    named = F.contains(low, F.lit(NAMES[0]))
    for name in NAMES[1:]:
        named = named | F.contains(low, F.lit(name))
    named, keyed, hexed = named & text.rlike(ASSIGN), F.contains(text, F.lit("AKIA")), text.rlike(HEX)
    long_enough = lambda v: F.char_length(F.regexp_extract(v, ASSIGN, 2)) >= ASSIGN_VALUE
    rows = rows.select(
        "doc_id", "text",
        F.when(named, F.filter(_spans(text, ASSIGN), lambda s: long_enough(s["value"]))).otherwise(none).alias("assign"),
        F.when(keyed, _spans(text, ACCESS)).otherwise(none).alias("access"),
        F.when(hexed, _spans(text, HEX)).otherwise(none).alias("hex"),
        text.rlike(rf"(?<![{RUN_SIGNS}])(?=[{RUN_SIGNS}]*[A-Za-z])[{RUN_SIGNS}]{{16,}}").alias("able"),
    )
    # runs are looked for between the base spans: those are masked by one sign, and a run that has it is none
    clean, some = F.replace(text, F.lit(MARK), F.lit(" ")), lambda name: F.size(name) > 0
    rows = rows.withColumn("text", F.when(some("assign"), _masked(clean, ASSIGN, long_enough)).otherwise(clean))
    rows = rows.withColumn("text", F.when(some("access"), _masked(text, ACCESS)).otherwise(text))
    rows = rows.withColumn("text", F.when(some("hex"), _masked(text, HEX)).otherwise(text))
    signs = MARK + RUN_SIGNS
    rows = rows.withColumn("runs", F.when(F.col("able"), _spans(text, rf"(?<![{signs}])[{signs}]{{16,}}={{0,2}}")).otherwise(none))
    plain = lambda s: ~F.contains(s["value"], F.lit(MARK)) & s["value"].rlike("[A-Za-z]")
    markov = F.filter("runs", lambda s: plain(s) & random_stretch(s["value"], table, limit))
    return rows.select("doc_id", "assign", "access", "hex", markov.alias("markov"))


def joined(kinds: dict[str, Column]) -> Column:
    """kind:start:end of all spans by start, then kind in the order given, comma-joined."""
    def ranked(rank: int, kind: str):
        return lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.concat_ws(":", F.lit(kind), s["start"], s["end"]).alias("s"))

    each = [F.transform(c, ranked(i, k)) for i, (k, c) in enumerate(kinds.items())]
    return F.array_join(F.transform(F.array_sort(F.concat(*each)), lambda x: x["s"]), ",")


def report(docs: DataFrame) -> DataFrame:
    """op10's contract: counts, a digest of the base spans, and all spans."""
    found = scan(docs)
    base, spans = joined({k: F.col(k) for k in KINDS[:3]}), joined({k: F.col(k) for k in KINDS})
    counts = [F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts[:3], F.sha2(base, 256).alias("base_sha256"), spans.alias("spans"), counts[3])
