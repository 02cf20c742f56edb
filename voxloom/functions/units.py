"""Lengths and their units."""

from __future__ import annotations

# Metres in each unit.
METRES = {"inch": 0.0254, "cm": 1e-2, "mm": 1e-3, "um": 1e-6, "nm": 1e-9, "m": 1.0, "hm": 1e2, "km": 1e3}


def unit_factor(source: str, target: str) -> float:
    """What a length in source is multiplied by to be in target."""
    for unit in (source, target):
        if unit not in METRES:
            raise ValueError(f"no length in unit {unit}")
    return METRES[source] / METRES[target]
