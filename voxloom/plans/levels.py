"""Choices made before a plan is built: the level of a pyramid, the way to filter, parameters of a job."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

Ratio = tuple[int, int, int]


def local_level(levels: Sequence[Ratio], scale: float) -> Ratio:
    """The coarsest level whose every ratio is at most 1 / scale; full resolution without one."""
    most = max(1, int(1 / scale))
    fitting = [r for r in levels if max(r) <= most]
    return max(fitting, key=sum) if fitting else (1, 1, 1)


def remote_level(levels: Sequence[Ratio], scale: float) -> Ratio:
    """The level nearest to the scale; of equals the coarser."""
    return min(levels, key=lambda r: (sum(abs(x * scale - 1) for x in r), -sum(r)))


@dataclass
class Job:
    """Parameters of a batch job, saved and loaded as JSON."""

    name: str
    inputs: list[str] = field(default_factory=list)
    output: str = ""
    parameters: dict[str, float | int | str | bool] = field(default_factory=dict)

    def save(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def load(cls, text: str) -> Job:
        return cls(**json.loads(text))
