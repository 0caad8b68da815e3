"""External policies that remember: a state per episode.

A model that carries something from step to step (an estimate, a hidden state, its last level) cannot be a column function.  Here
Spark deals the steps by episode and orders them, and one policy object sees one episode.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, Row

from ..params import EpisodeParams


class Policy(Protocol):
    """Made anew for every episode; gets its steps in order."""

    def act(self, step: Row) -> int:
        """The price level for this step."""


class CautiousStep:
    """The rule of thumb as such a policy: one level up or down from the last one when demand has moved."""

    def __init__(self, levels: int = 11, threshold: float = 0.1, trend: str = "trend_before"):
        self.level, self.top, self.threshold, self.trend = levels // 2, levels - 1, threshold, trend

    def act(self, step: Row) -> int:
        moved = step[self.trend]
        if moved > self.threshold:
            self.level = min(self.level + 1, self.top)
        elif moved < -self.threshold:
            self.level = max(self.level - 1, 0)
        return self.level


def rule_policy(params: EpisodeParams = EpisodeParams(), trend: str = "trend_before") -> Callable[[], Policy]:
    levels, threshold = params.price_levels, params.trend_threshold
    return lambda: CautiousStep(levels, threshold, trend)


def stateful_levels(steps: DataFrame, keys: list[str], order: str, make: Callable[[], Policy], partitions: int | None = None) -> DataFrame:
    """``keys, order, action``: the level that a policy made by ``make`` chooses at every step.

    ``keys`` name an episode.  Steps are dealt by episode, over ``partitions`` tasks if given, and sorted; a batch of rows
    holds many episodes or a part of one, and a task holds one policy at a time.
    """
    types = dict(steps.dtypes)
    shown = [*keys, order]
    ddl = ", ".join(f"`{c}` {types[c]}" for c in shown) + ", action int"
    names = steps.columns

    def play(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, last, policy = Row(*names), None, None
        for batch in batches:
            episodes = zip(*(batch.column(c).to_pylist() for c in keys))
            steps_ = zip(*(column.to_pylist() for column in batch.columns))
            levels = []
            for episode, values in zip(episodes, steps_):
                if policy is None or episode != last:
                    policy, last = make(), episode
                levels.append(int(policy.act(row(*values))))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in shown), pa.array(levels, pa.int32())], [*shown, "action"])

    dealt = steps.repartition(*keys) if partitions is None else steps.repartition(partitions, *keys)
    return dealt.sortWithinPartitions(*shown).mapInArrow(play, ddl)
