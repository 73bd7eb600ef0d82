"""Tree ensembles as SQL text: nested CASE over feature columns, weights summed.

The text is plain SQL, so a fitted model scores rows in any engine, and in Spark without a vector
column. Numbers are written as doubles with an exponent, which reads as a double everywhere.
Features must not be null: Spark's assembler refuses or skips such rows before a model sees them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.ml import Model

# Lines of Spark's description of a fitted tree.
_TREE = re.compile(r"^\s*Tree \d+ \(weight (\S+)\):$")
_IF = re.compile(r"^\s*If \(feature (\d+) <= (\S+)\)$")
_ELSE = re.compile(r"^\s*Else \(feature \d+ > \S+\)$")
_LEAF = re.compile(r"^\s*Predict: (\S+)$")


@dataclass(frozen=True, slots=True)
class Split:
    """Rows whose feature is at most the threshold go to ``low``, others to ``high``."""

    feature: int
    threshold: float
    low: Node
    high: Node


@dataclass(frozen=True, slots=True)
class Leaf:
    """One value, or one share of votes for each class."""

    values: tuple[float, ...]


Node = Split | Leaf


def number(value: float) -> str:
    """A double literal that no engine reads as a decimal."""
    text = repr(float(value))
    if "n" in text:
        raise ValueError(f"{text} has no SQL literal")
    return text if "e" in text else f"{text}E0"


def _read_tree(lines: Iterator[str]) -> Node:
    line = next(lines)
    if leaf := _LEAF.match(line):
        return Leaf((float(leaf[1]),))
    head = _IF.match(line)
    if not head:
        raise ValueError(f"no split of a continuous feature: {line.strip()!r}")
    low = _read_tree(lines)
    if not _ELSE.match(otherwise := next(lines)):
        raise ValueError(f"no other side: {otherwise.strip()!r}")
    return Split(int(head[1]), float(head[2]), low, _read_tree(lines))


def regression_trees(model: Model) -> list[tuple[float, Node]]:
    """Weight and root of each tree of a fitted regression ensemble."""
    trees, lines = [], iter(model.toDebugString.splitlines())
    for line in lines:
        if head := _TREE.match(line):
            trees.append((float(head[1]), _read_tree(lines)))
    return trees


def classification_trees(model: Model) -> list[Node]:
    """Roots of a fitted forest; leaves hold the share of each class among their training rows."""

    def read(node) -> Node:
        if node.getClass().getSimpleName() == "LeafNode":
            counts = list(node.impurityStats().stats())
            total = sum(counts)
            return Leaf(tuple(count / total if total else 0.0 for count in counts))
        split = node.split()
        if split.getClass().getSimpleName() != "ContinuousSplit":
            raise ValueError("no split of a continuous feature")
        return Split(
            split.featureIndex(), split.threshold(), read(node.leftChild()), read(node.rightChild())
        )

    return [read(tree._java_obj.rootNode()) for tree in model.trees]


def tree_sql(node: Node, features: Sequence[str], value: Callable[[Leaf], float]) -> str:
    """One tree as nested CASE; sides that say the same are one."""
    if isinstance(node, Leaf):
        return number(value(node))
    low, high = tree_sql(node.low, features, value), tree_sql(node.high, features, value)
    if low == high:
        return low
    return f"CASE WHEN {features[node.feature]} <= {number(node.threshold)} THEN {low} ELSE {high} END"


def regression_sql(model: Model, features: Sequence[str]) -> str:
    """The prediction of boosted regression trees."""
    terms = [
        f"{number(weight)} * ({tree_sql(root, features, lambda leaf: leaf.values[0])})"
        for weight, root in regression_trees(model)
    ]
    return "\n + ".join(terms)


def votes_sql(model: Model, features: Sequence[str]) -> list[str]:
    """The sum of votes for each class, trees in the order in which Spark adds them."""
    roots = classification_trees(model)
    return [
        "\n + ".join(
            f"({tree_sql(root, features, lambda leaf, c=c: leaf.values[c])})" for root in roots
        )
        for c in range(model.numClasses)
    ]


def most_votes_sql(votes: Sequence[str]) -> str:
    """The class of the most votes, the first of equal ones; ``votes`` are columns."""
    *others, last = range(len(votes))
    cases = [
        f"WHEN {' AND '.join(f'{votes[c]} >= {votes[d]}' for d in range(c + 1, len(votes)))} THEN {number(c)}"
        for c in others
    ]
    return f"CASE {' '.join(cases)} ELSE {number(last)} END" if cases else number(last)


def regression_select(model: Model, features: Sequence[str], source: str, name: str = "prediction") -> str:
    """A whole query: the rows of ``source`` with their prediction."""
    return f"SELECT *, {regression_sql(model, features)} AS {name}\nFROM {source}"


def classification_select(
    model: Model, features: Sequence[str], source: str, name: str = "prediction"
) -> str:
    """A whole query: the rows of ``source`` with their class; votes are summed once, in an inner query."""
    names = [f"{name}_votes_{c}" for c in range(model.numClasses)]
    sums = ",\n".join(f"{sql} AS {vote}" for sql, vote in zip(votes_sql(model, features), names))
    return f"SELECT *, {most_votes_sql(names)} AS {name}\nFROM (SELECT *,\n{sums}\nFROM {source}) AS voted"
