"""Multiple-choice options, their orderings and the right letter of each ordering."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradelens import values as v
from gradelens.functions.answers import letter_array


def build_options(wrong: Column, correct: Column) -> Column:
    """The wrong options followed by the correct one (A1)."""
    return F.array_append(wrong, correct)


def orderings(k: int) -> Column:
    """Literal list of all orderings of ``k`` positions, lexicographic by position (A2)."""
    return F.lit([list(order) for order in itertools.permutations(range(k))]).cast(
        "array<array<int>>"
    )


def ordering_count(k: int) -> int:
    return math.factorial(k)


def arrange(options: Column, order: Column) -> Column:
    """The options in the given order."""
    return F.transform(order, lambda position: F.get(options, position))


def correct_symbol(arranged: Column, correct: Column) -> Column:
    """Letter of the first slot that holds the correct value (A3)."""
    slots = F.transform(arranged, lambda option: option.eqNullSafe(correct))
    return F.get(
        letter_array(len(v.LETTERS)), (F.array_position(slots, True) - 1).cast("int")
    )


def option_count_check(options: Column, k: int) -> Column:
    """Whether there are exactly ``k`` options (A4)."""
    return F.coalesce(F.size(options) == k, F.lit(False))


def answer_key(wrong: Column, correct: Column, k: int) -> Column:
    """Right letters of all orderings as one short string, without building any ordering.

    Only which wrong options equal the correct one matters. That is a pattern of k-1 bits,
    and the key of every pattern is a literal.
    """
    keys = []
    for pattern in range(2 ** (k - 1)):
        equal = [bool(pattern >> i & 1) for i in range(k - 1)] + [True]
        keys.append(
            "".join(
                v.LETTERS[[equal[position] for position in order].index(True)]
                for order in itertools.permutations(range(k))
            )
        )
    pattern = F.lit(0)
    for i in range(k - 1):
        pattern = pattern + F.when(F.get(wrong, F.lit(i)).eqNullSafe(correct), 2**i).otherwise(0)
    return F.get(F.array(*[F.lit(key) for key in keys]), pattern)


def change_type_phrase(change_type: Column) -> Column:
    """English phrase of a change type; an unknown one is an error."""
    pairs = [F.lit(part) for pair in v.CHANGE_PHRASES.items() for part in pair]
    phrase = F.create_map(*pairs)[change_type]
    return F.coalesce(
        phrase,
        F.raise_error(
            F.concat(F.lit("unknown change type: "), F.coalesce(change_type, F.lit("null")))
        ).cast("string"),
    )
