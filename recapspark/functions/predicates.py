"""Row predicates, fixed and assembled at run time."""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from recapspark.config import (
    EXCLUDED_TAGS,
    GROWTH_RANGE,
    MAX_GROWTH_GAP_DAYS,
    MODEL_SPECIES,
    UNTAGGED_MARKS,
)


def _values(value: Any) -> list:
    return list(value) if isinstance(value, (list, tuple, set, frozenset)) else [value]


def _is_in(c: Column, value: Any) -> Column:
    """Membership that is never NULL: a missing value is in the set only if listed."""
    values = _values(value)
    known = [v for v in values if v is not None]
    hit = F.coalesce(c.isin(*known), F.lit(False)) if known else F.lit(False)
    return hit | c.isNull() if None in values else hit


#: Comparison by its symbol; value is compared with the column on the left.
OPERATORS = {
    "==": operator.eq,
    "!=": operator.ne,
    "<": operator.lt,
    "<=": operator.le,
    ">": operator.gt,
    ">=": operator.ge,
    "%in%": _is_in,
    "%notin%": lambda c, v: ~_is_in(c, v),
}


def all_of(cols: Sequence[str], ops: Sequence[str], vals: Sequence[Any]) -> Column:
    """AND of ``cols[i] ops[i] vals[i]``; three empty lists keep every row."""
    if not len(cols) == len(ops) == len(vals):
        raise ValueError("cols, ops and vals must have the same length")
    unknown = sorted(set(ops) - set(OPERATORS))
    if unknown:
        raise ValueError(f"unknown operators: {unknown}")
    terms = [OPERATORS[op](F.col(c), v) for c, op, v in zip(cols, ops, vals)]
    return reduce(operator.and_, terms, F.lit(True))


def is_tagged(tag: Column | None = None) -> Column:
    """The fish carries a tag with an identity."""
    tag = F.col("tag") if tag is None else tag
    return tag.isNotNull() & ~tag.isin(*UNTAGGED_MARKS)


def enters_histories(
    species: str = MODEL_SPECIES, excluded_tags: Sequence[str] = EXCLUDED_TAGS
) -> Column:
    """Rows that may fill an encounter history: one species, without known bad tags."""
    keep = is_tagged() & (F.col("species") == species)
    return keep & ~F.col("tag").isin(*excluded_tags) if excluded_tags else keep


def plausible_growth(
    max_gap_days: int = MAX_GROWTH_GAP_DAYS,
    bounds: tuple[float, float] = GROWTH_RANGE,
) -> Column:
    """Growth between two captures that are close in time and of a sane size."""
    low, high = bounds
    return (
        (F.col("dateDiff") < max_gap_days)
        & (F.col("growth") > low)
        & (F.col("growth") < high)
    )
