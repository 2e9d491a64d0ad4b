"""Three-valued answers: checked and fine, checked and wrong, could not be checked.

A verdict is always one of the words of a fixed order, never NULL, so that a missing
fact can't pass for either answer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MET, VIOLATED, CANNOT_CHECK = "MET", "VIOLATED", "CANNOT_CHECK"


def verdict(wrong: Column, unknown: Column) -> Column:
    """VIOLATED where ``wrong`` is true, CANNOT_CHECK where ``unknown`` is true or nothing is known, else MET."""
    return F.when(F.coalesce(wrong, F.lit(False)), VIOLATED).when(F.coalesce(unknown, F.lit(True)), CANNOT_CHECK).otherwise(MET)


def worst_of(word: Column, severity: Sequence[str], empty: str) -> Column:
    """Aggregate: the first word of ``severity`` that occurs; ``empty`` over no rows or unknown words."""
    rank = F.lit(None).cast("int")
    for k, name in reversed(list(enumerate(severity))):
        rank = F.when(word == name, k).otherwise(rank)
    names = F.array(*(F.lit(n) for n in severity))
    return F.coalesce(F.get(names, F.min(rank)), F.lit(empty))


def tally(word: Column, *names: str) -> list[Column]:
    """Aggregates: how often each name occurs, as n_<name in lower case>."""
    return [F.count_if(word == n).alias(f"n_{n.lower()}") for n in names]


def exit_code(answer: Column, wrong: Sequence[str], unknown: Sequence[str]) -> Column:
    """0 fine, 1 wrong, 2 could not be checked."""
    return F.when(answer.isin(*wrong), 1).when(answer.isin(*unknown), 2).otherwise(0)
