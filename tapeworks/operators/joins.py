"""Equi-joins against reference data, and anti joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup(
    facts: DataFrame, reference: DataFrame, on: dict[str, str], take: Sequence[str | Column], how: str = "left"
) -> DataFrame:
    """Join ``facts`` to ``reference`` rows, unique on the keys, taking the columns ``take``.

    ``on`` maps fact columns to reference columns. Building the plan runs nothing: a stored table within the
    session's broadcast threshold is broadcast by its size in files, a computed one by its size at run time, and
    beyond that both sides are shuffled, where adaptive execution splits the partitions of hot keys (NULL included).
    """
    right_keys = {f"_key_{i}": F.col(right) for i, right in enumerate(on.values())}
    picked = [F.col(c) if isinstance(c, str) else c for c in take]
    right = reference.select(*[c.alias(n) for n, c in right_keys.items()], *picked).dropna(subset=list(right_keys))
    condition = F.lit(True)
    for i, left in enumerate(on):
        condition = condition & (F.col(left) == F.col(f"_key_{i}"))
    return facts.join(right, condition, how).drop(*right_keys)


def meeting(columns: Sequence[str]) -> Column:
    """Hash by which rows alike in ``columns`` meet, NULL like NULL."""
    return F.xxhash64(*columns)


def all_same(keys: Sequence[str]) -> Column:
    """Whether all ``keys`` equal their ``_have_`` columns, NULL like NULL, in a form that is no join key: the rows
    meet by another one."""
    return F.array_min(F.array(*[F.col(k).eqNullSafe(F.col(f"_have_{k}")) for k in keys]))


def not_in(new: DataFrame, existing: DataFrame, keys: Sequence[str], meet: Sequence[str] = ()) -> DataFrame:
    """Rows of ``new`` whose key is absent from ``existing``; NULL key parts compare as equal.

    With ``meet``, some of the keys, rows meet by the hash of these and the whole key is compared there: rows
    that ``first_by_key`` has sent by the same columns stay where they are. Few rows should share these columns.
    """
    have = existing.select(*[F.col(k).alias(f"_have_{k}") for k in keys])
    if meet:
        there = meeting([f"_have_{k}" for k in meet])
        return new.join(have, (meeting(meet) == there) & all_same(keys), "left_anti")
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_have_{k}"))
    return new.join(have, condition, "left_anti")
