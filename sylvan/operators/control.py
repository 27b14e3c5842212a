"""The commit protocol as data: a packet log, its statistics, and the advantage they lead to."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FAST = 0.9


def packet_type(has_tree: Column, base_size: Column, model_size: Column) -> Column:
    """Accept, Empty (nothing to add) or BaseVersionMismatch (found on another model than today's)."""
    return F.when(~has_tree, "Empty").when(base_size != model_size, "BaseVersionMismatch").otherwise("Accept")


def counts(packets: DataFrame) -> DataFrame:
    """source, packet_type, n."""
    return packets.groupBy("source", "packet_type").agg(F.count("*").alias("n"))


def condition(rate: Column) -> Column:
    return F.when(rate <= 0, "TooSlow").when(rate >= FAST, "TooFast").otherwise("Okay")


def condition_of(rate: float) -> str:
    """condition() of one number."""
    return "TooSlow" if rate <= 0 else "TooFast" if rate >= FAST else "Okay"


def accept_rate(packets: DataFrame, last: int) -> DataFrame:
    """For each packet of its source, in order: accepts among the last `last` Accept or Empty packets over `last` (empty places count), and the condition."""
    if last < 1:
        raise ValueError("the queue holds one packet at least")
    w = Window.partitionBy("source").orderBy("packet_id").rowsBetween(1 - last, 0)
    own = packets.where(F.col("packet_type").isin("Accept", "Empty"))
    rate = F.sum((F.col("packet_type") == "Accept").cast("int")).over(w) / last
    return own.withColumn("rate", rate).withColumn("condition", condition(F.col("rate")))


def trend(rated: DataFrame) -> DataFrame:
    """Whether a packet's condition is an extreme and that of the one before (same), the opposite extreme (opposite) or neither (other)."""
    before = F.lag("condition").over(Window.partitionBy("source").orderBy("packet_id"))
    now = F.col("condition")
    opposite = ((now == "TooFast") & (before == "TooSlow")) | ((now == "TooSlow") & (before == "TooFast"))
    return rated.withColumn("trend", F.when(before.isNull(), "other").when((now == before) & (now != "Okay"), "same").when(opposite, "opposite").otherwise("other"))


def next_gamma(gamma: float, now: str, least: float, most: float = 0.499) -> float:
    """Too fast: the target rises; too slow: it halves; within [least, most]."""
    return min(most, max(least, gamma / 0.9 if now == "TooFast" else gamma * 0.5 if now == "TooSlow" else gamma))


def gamma_path(rated: DataFrame, start: float, least: float, every: int) -> DataFrame:
    """step, condition, gamma of one source's decisions, one each `every` packets, as log steps summed in order and then exponentiated (unclamped within the run)."""
    w = Window.partitionBy("source").orderBy("packet_id")
    steps = rated.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") % every == 0)
    factor = F.when(F.col("condition") == "TooFast", -F.log(F.lit(0.9))).when(F.col("condition") == "TooSlow", F.log(F.lit(0.5))).otherwise(0.0)
    run = F.sum(factor).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return steps.select("source", "packet_id", "condition", F.least(F.lit(0.499), F.greatest(F.lit(least), start * F.exp(run))).alias("gamma"))


@dataclass(frozen=True)
class Task:
    """What a worker is told: model version, target, and where it may split (null: anywhere); a sample version if there is a new one."""

    model_size: int
    gamma: float
    expand_node: int | None = None
    sample_version: int | None = None

    def same_as(self, new: Task) -> bool:
        """Whether a worker on this task may go on with it when told the new one: a null node there means any."""
        return (self.model_size, self.gamma) == (new.model_size, new.gamma) and new.expand_node in (None, self.expand_node)

    def merged(self, old: Task) -> Task:
        """This task, with the old one's node and sample version where it names none."""
        return replace(self, expand_node=old.expand_node if self.expand_node is None else self.expand_node, sample_version=old.sample_version if self.sample_version is None else self.sample_version)


def reply(last: Task, new: Task, outcome: str) -> str:
    """Whom a new task goes to: all if it says anything new, the sender alone if it had nothing to add, else nobody."""
    return "all" if new != last else "sender" if outcome == "Empty" else "nobody"


def idle(assigned: DataFrame) -> DataFrame:
    """The workers (source, task) without a task."""
    return assigned.where(F.col("task").isNull())


def assignments(assigned: DataFrame, capacity: int) -> DataFrame:
    """The first `capacity` idle workers by number, `place` counting from 0."""
    w = Window.partitionBy().orderBy("source")  # one row a worker
    return idle(assigned).withColumn("place", F.row_number().over(w) - 1).where(F.col("place") < capacity)


def worker_counts(assigned: DataFrame) -> DataFrame:
    """working, idle."""
    return assigned.agg(F.count("task").alias("working"), (F.count("*") - F.count("task")).alias("idle"))


def fresh(updates: DataFrame, least: int) -> DataFrame:
    """Updates of version `least` or later."""
    return updates.where(F.col("version") >= least)
