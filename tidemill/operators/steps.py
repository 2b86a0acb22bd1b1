"""Steps written as Python functions over DataFrames."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame


def run_step(step: Callable[..., DataFrame], params: Mapping[str, Any]) -> DataFrame:
    """Calls a step with those of the parameters that it names (all of them if it takes any); a parameter that it needs and doesn't get is an error, and so is a result that is no DataFrame."""
    wanted = inspect.signature(step).parameters.values()
    if not any(p.kind is p.VAR_KEYWORD for p in wanted):
        params = {k: v for k, v in params.items() if k in {p.name for p in wanted}}
    if missing := [p.name for p in wanted if p.default is p.empty and p.kind in (p.POSITIONAL_OR_KEYWORD, p.KEYWORD_ONLY) and p.name not in params]:
        raise ValueError(f"step {getattr(step, '__name__', step)!r} lacks {', '.join(missing)}")
    out = step(**params)
    if not isinstance(out, DataFrame):
        raise TypeError(f"step {getattr(step, '__name__', step)!r} returned {type(out).__name__}, not a DataFrame")
    return out
