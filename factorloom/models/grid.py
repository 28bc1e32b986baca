"""Parameter grids: list values are candidates, scalars are fixed."""

from __future__ import annotations

from itertools import product


def param_grid(spec: dict) -> list[dict]:
    lists = {k: v for k, v in spec.items() if isinstance(v, list)}
    fixed = {k: v for k, v in spec.items() if not isinstance(v, list)}
    return [fixed | dict(zip(lists, combo)) for combo in product(*lists.values())]


def default_params(spec: dict) -> dict:
    return {k: v[0] if isinstance(v, list) else v for k, v in spec.items()}
