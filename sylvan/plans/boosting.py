"""The training loop: trees from samples, each split by the first rule that passes the stopping test."""

from __future__ import annotations

import math
import random
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import binning, control, rules, sampling, statistics
from ..sources.shared import dropped, settled
from ..sources.stores import Store
from .config import Config
from .tree import Model, Tree

#: Tries in a row without a tree after which a training ends.
MOST_FAILURES = 12
PREDICTIONS = {0: (-1.0, 1.0), 1: (1.0, -1.0)}


@dataclass
class Commit:
    """What a commit did: Accept, Empty or BaseVersionMismatch."""

    outcome: str
    size: int


def commit(model: Model, base_size: int, tree: Tree | None) -> Commit:
    """Append a tree that was found on today's model; anything else changes nothing."""
    if tree is None:
        return Commit("Empty", model.size)
    if base_size != model.size:
        return Commit("BaseVersionMismatch", model.size)
    model.append(tree)
    model.set_base()
    return Commit("Accept", model.size)


@dataclass
class Trainer:
    """Grows a model over binned rows (row_id, label, codes). Each tree: a root split at a random feature's upper median, then a split per passing rule until the
    tree is full; a tree that no rule completes is dropped, and one is not begun while the sample's effective size is under the floor: then a new sample is drawn by weight.

    After each try the advantage asked for (gamma) follows the share of the last `last_outcomes` tries that gave a tree: none lowers it, nearly all raise it.
    With a store, samples, models and the state are written as they come, and the same trainer over the same rows goes on from there. All that is random depends on
    the seed, the number of the try and that of the sample alone, so a training that was stopped and resumed gives the same model as one that was not."""

    rows: DataFrame
    config: Config
    model: Model = field(default_factory=Model)
    store: Store | None = None
    log: list[dict] = field(default_factory=list)

    def __post_init__(self):
        self.gamma, self.tries, self.draws, self.outcomes = self.config.default_gamma, 0, 0, []
        self.sample, self.ess, self.failures = None, None, 0
        self.width = (self.rows.select(F.size("codes")).first() or [0])[0]

    def resume(self) -> None:
        """Take model, state and sample from the store, as far as they are there."""
        state = self.store.read_state()
        if state is None:
            return
        self.model = self.store.read_model(state["size"]) if state["size"] else Model()
        self.model.set_base()
        self.gamma, self.tries, self.draws, self.outcomes, self.failures = (state[k] for k in ("gamma", "tries", "draws", "outcomes", "failures"))
        self.sample = self.store.read_sample(self.draws)

    def _keep_state(self) -> None:
        if self.store:
            self.store.write_state({"size": self.model.size, "gamma": self.gamma, "tries": self.tries, "draws": self.draws, "outcomes": self.outcomes, "failures": self.failures})

    def refresh(self) -> None:
        """Rescore all rows, draw a sample by weight, hold it until the next."""
        scored = statistics.rescore(self.rows.withColumns({"score": F.lit(0.0), "version": F.lit(0)}), self.model)
        self.draws += 1
        drawn = sampling.draw(settled(scored, "scored"), self.config.sample_size, self.config.seed + self.draws)
        drawn = statistics.init_sample(drawn, self.model.size).drop("row_id").withColumnRenamed("shuffle_key", "row_id")
        if self.store:
            self.store.write_sample(drawn, self.draws)
            self.sample = self.store.read_sample(self.draws)
        else:
            old, self.sample = self.sample, settled(drawn, "sample")
            if old is not None:
                dropped(old)
        self._keep_state()

    def grow(self) -> tuple[str, Tree | None]:
        """(Succeed, FailedToTrigger or LowESS; a full tree if it succeeded)."""
        now = settled(statistics.batches(statistics.rescore(self.sample, self.model), self.config.batch_size), "weighted")
        try:
            self.ess = statistics.effective_sample_size(now).first()["ess"] or 0.0
            if self.ess < self.config.min_ess:
                return "LowESS", None
            tree = Tree(self.config.num_splits)
            feature = random.Random(f"{self.config.seed} {self.tries}").randrange(self.width)
            median = binning.upper_median(now.select(F.get("codes", F.lit(feature)).alias("c")), "c").first()["value"]
            tree.split(0, feature, int(median), 0.0, 0.0)
            value = 0.5 * math.log((0.5 + self.gamma) / (0.5 - self.gamma))
            while not tree.full:
                found = rules.first_passing(now.withColumn("leaf", tree.leaf(F.col("codes"))), self.config.max_bin_size + 1, self.gamma).first()
                if found is None:
                    return "FailedToTrigger", None
                self.log.append({"event": "rule", **rules.log_record(found.asDict(), self.gamma, value)})
                left, right = (value * p for p in PREDICTIONS[found["rule"]])
                tree.split(found["leaf"], found["feature"], found["code"], left, right)
            return "Succeed", tree
        finally:
            dropped(now)

    def run(self, trees: int | None = None) -> Model:
        """Trees until there are `trees` more (the configured number), or MOST_FAILURES tries in a row have given none."""
        goal = self.model.size + (self.config.num_trees if trees is None else trees)
        if self.sample is None:
            self.refresh()
        while self.model.size < goal and self.failures < MOST_FAILURES:
            outcome, tree = self.grow()
            self.tries += 1
            done = commit(self.model, self.model.size, tree)
            self.log.append({"event": "try", "outcome": outcome, "commit": done.outcome, "gamma": self.gamma, "ess": self.ess, "size": self.model.size})
            self.failures = 0 if done.outcome == "Accept" else self.failures + 1
            if done.outcome == "Accept" and self.store:
                self.store.write_model(self.model)
            if outcome == "LowESS":
                self.refresh()  # nothing is published, so the tries that count stay as they are
                continue
            self.outcomes = [*self.outcomes, done.outcome][-self.config.last_outcomes :]
            rate = self.outcomes.count("Accept") / self.config.last_outcomes
            self.gamma = control.next_gamma(self.gamma, control.condition_of(rate), self.config.min_gamma)
            self._keep_state()
        return self.model
