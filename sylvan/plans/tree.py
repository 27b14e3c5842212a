"""Regression trees over bin codes, additive models of them, and their compilation into Columns."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.columns import TOLERANCE

#: Trees in one scoring expression; a larger model is scored in several projections, so that none outgrows the code generator.
TREES_PER_STEP = 20


@dataclass
class Node:
    predict: float = 0.0  # the sum of the values on the way from the root
    depth: int = 0
    left: int = -1
    right: int = -1
    feature: int | None = None
    threshold: int = 0


@dataclass
class Tree:
    """At most `splits` splits. A row whose code is at most the threshold goes left."""

    splits: int
    nodes: list[Node] = field(default_factory=lambda: [Node()])

    @property
    def full(self) -> bool:
        return len(self.nodes) >= 2 * self.splits + 1

    @property
    def leaves(self) -> list[int]:
        return [i for i, n in enumerate(self.nodes) if n.feature is None]

    def split(self, at: int, feature: int, threshold: int, left: float, right: float) -> tuple[int, int]:
        node = self.nodes[at]
        if node.feature is not None or self.full:
            raise ValueError("the node is split already, or the tree is full")
        node.feature, node.threshold = feature, threshold
        node.left, node.right = len(self.nodes), len(self.nodes) + 1
        self.nodes += [Node(node.predict + delta, node.depth + 1) for delta in (left, right)]
        return node.left, node.right

    def _compiled(self, codes: Column, leaf_value, at: int = 0) -> Column:
        n = self.nodes[at]
        if n.feature is None:
            return F.lit(leaf_value(at, n))
        return F.when(F.get(codes, F.lit(n.feature)) <= n.threshold, self._compiled(codes, leaf_value, n.left)).otherwise(self._compiled(codes, leaf_value, n.right))

    def leaf(self, codes: Column) -> Column:
        return self._compiled(codes, lambda i, n: i)

    def value(self, codes: Column) -> Column:
        return self._compiled(codes, lambda i, n: float(n.predict))

    def __eq__(self, other) -> bool:
        if not isinstance(other, Tree) or len(self.nodes) != len(other.nodes):
            return False
        shape = lambda n: (n.left, n.right, n.feature, n.threshold, n.depth)
        return all(shape(a) == shape(b) and abs(a.predict - b.predict) <= TOLERANCE for a, b in zip(self.nodes, other.nodes, strict=True))


@dataclass
class Model:
    """Trees in order. base: trees at the last commit from elsewhere; its version is its number of trees."""

    trees: list[Tree] = field(default_factory=list)
    base: int = 0

    @property
    def size(self) -> int:
        return len(self.trees)

    def append(self, tree: Tree) -> None:
        self.trees.append(tree)

    def set_base(self) -> None:
        self.base = self.size

    def last_new(self) -> Tree | None:
        return self.trees[-1] if self.size > self.base else None

    def score(self, codes: Column, start: int = 0, stop: int | None = None) -> Column:
        """The sum of the leaf values of trees start..stop."""
        out = F.lit(0.0)
        for tree in self.trees[start:stop]:
            out = out + tree.value(codes)
        return out

    def to_dict(self) -> dict:
        return {"models": [asdict(t) for t in self.trees], "base_size": self.base}

    @staticmethod
    def from_dict(x: dict) -> Model:
        return Model([Tree(t["splits"], [Node(**n) for n in t["nodes"]]) for t in x["models"]], x["base_size"])

    def to_json(self) -> str:
        return json.dumps(self.to_dict())

    @staticmethod
    def from_json(text: str) -> Model:
        return Model.from_dict(json.loads(text))
