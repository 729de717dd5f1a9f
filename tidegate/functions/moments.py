"""Spread from mergeable states (number, mean, sum of squared deviations), as SQL texts.

States are merged around their common mean, so values with a large mean and a small spread keep
it, where sums of squares would cancel.
"""

from __future__ import annotations

from collections.abc import Sequence


def state(value: str) -> tuple[str, str, str]:
    """Aggregates of a column: n, mean, m2."""
    return f"count({value})", f"avg({value})", f"var_pop({value}) * count({value})"


def merged(parts: Sequence[tuple[str, str, str]]) -> tuple[str, str]:
    """Number and mean of states side by side in a row; a state without rows has the number 0 or null."""
    n = " + ".join(f"coalesce({n}, 0)" for n, _, _ in parts)
    total = " + ".join(f"coalesce({n} * {mean}, 0D)" for n, mean, _ in parts)
    return f"({n})", f"(({total}) / nullif({n}, 0))"


def merged_m2(parts: Sequence[tuple[str, str, str]], mean: str) -> str:
    """Sum of squared deviations of states side by side, given their common mean."""
    return "(" + " + ".join(f"coalesce({m2} + {n} * pow({m} - {mean}, 2), 0D)" for n, m, m2 in parts) + ")"


def std(n: str, m2: str) -> str:
    """Sample standard deviation; 0 below two rows."""
    return f"CASE WHEN {n} >= 2 THEN sqrt({m2} / ({n} - 1)) ELSE 0D END"


def running(n: str, mean: str, m2: str, window: str) -> list[list[str]]:
    """Columns, in three steps, of the running state over an ordered window text: ``_rn``, ``_rmean``, ``_rm2``.

    Every row adds its own deviations and those between its mean and the mean before it; nothing is subtracted.
    """
    before = f"OVER ({window} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return [
        [f"coalesce(sum({n}) {before}, 0) AS _bn", f"coalesce(sum({n} * {mean}) {before}, 0D) AS _bsum"],
        [f"_bn + {n} AS _rn", f"(_bsum + coalesce({n} * {mean}, 0D)) / nullif(_bn + {n}, 0) AS _rmean",
         f"coalesce({m2}, 0D) + coalesce(pow({mean} - _bsum / nullif(_bn, 0), 2) * _bn * {n} / nullif(_bn + {n}, 0), 0D) AS _inc"],
        [f"sum(_inc) OVER ({window} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _rm2"],
    ]
