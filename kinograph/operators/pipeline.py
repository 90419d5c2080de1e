"""Plugins as an ordered list of DataFrame transforms around the evaluation of a timeline."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

Transform = Callable[[DataFrame], DataFrame]


@dataclass
class Pipeline:
    """``before`` transforms see the active clips of every frame, ``after`` transforms the finished frames."""

    before: list[Transform] = field(default_factory=list)
    after: list[Transform] = field(default_factory=list)

    def use(self, before: Transform | None = None, after: Transform | None = None) -> Pipeline:
        return Pipeline([*self.before, *([before] if before else [])], [*self.after, *([after] if after else [])])

    def run(self, active: DataFrame, render: Transform) -> DataFrame:
        for f in self.before:
            active = active.transform(f)
        frames = active.transform(render)
        for f in self.after:
            frames = frames.transform(f)
        return frames
