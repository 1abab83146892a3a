"""Scores of one generated text against its gold text.

Each metric settles most rows with a native string search and walks the lines of the
prediction only where the gold text does occur, but not at the start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelens.functions import text as tx

METRICS = ("em", "em_trim", "em_no_space", "em_no_comment")


def _flag(hit: Column) -> Column:
    return hit.cast("int")


def once(bound: Column, body) -> Column:
    """``body`` over a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(bound), body), F.lit(0))


def _line_walk(line_array: Column, hit_at) -> Column:
    """True when ``hit_at(offset, line)`` holds for some line.

    ``offset`` is the summed length of the lines before it.
    """
    start = F.struct(F.lit(0).alias("offset"), F.lit(False).alias("hit"))
    return F.aggregate(
        line_array,
        start,
        lambda acc, line: F.struct(
            (acc["offset"] + F.length(line)).alias("offset"),
            (acc["hit"] | hit_at(acc["offset"], line)).alias("hit"),
        ),
        lambda acc: acc["hit"],
    )


def _em(gold_spaced: Column, pred_spaced: Column) -> Column:
    return _flag(gold_spaced == pred_spaced)


def _em_trim(gold_spaced: Column, pred_spaced: Column, pred: Column) -> Column:
    blank = F.lit(" ")
    at_start = (gold_spaced == "") | F.startswith(
        F.concat(pred_spaced, blank), F.concat(gold_spaced, blank)
    )
    somewhere = F.contains(
        F.concat(blank, pred_spaced, blank), F.concat(blank, gold_spaced, blank)
    )
    both = F.struct(
        F.split(gold_spaced, " ", -1).alias("gold"), F.split(pred_spaced, " ", -1).alias("pred")
    )
    walk = once(
        both,
        lambda words: _line_walk(
            tx.lines(pred),
            lambda offset, _: (offset + F.size(words["gold"]) <= F.size(words["pred"]))
            & (F.get(words["pred"], offset) == F.get(words["gold"], F.lit(0)))
            & (F.slice(words["pred"], offset + 1, F.size(words["gold"])) == words["gold"]),
        ),
    )
    return F.when(at_start, 1).when(~somewhere, 0).otherwise(_flag(walk))


def _em_no_space(gold_squashed: Column, pred_squashed: Column, pred: Column) -> Column:
    walk = _line_walk(
        tx.lines(tx.squash_lines(pred)),
        lambda offset, line: (line != "")
        & (F.startswith(gold_squashed, line) | F.startswith(line, gold_squashed))
        & (F.substr(pred_squashed, offset + 1, F.length(gold_squashed)) == gold_squashed),
    )
    return (
        F.when(F.startswith(pred_squashed, gold_squashed), 1)
        .when(~F.contains(pred_squashed, gold_squashed), 0)
        .otherwise(_flag(walk))
    )


def em(gold: Column, pred: Column) -> Column:
    """1 when both texts have the same words (M1)."""
    return _em(tx.spaced(gold), tx.spaced(pred))


def em_trim(gold: Column, pred: Column) -> Column:
    """1 when the gold words start at a word position that is a line offset of pred (M2).

    Line offsets are character counts; using them as word positions is the published rule.
    """
    both = F.struct(tx.spaced(gold).alias("gold"), tx.spaced(pred).alias("pred"))
    return once(both, lambda spaced: _em_trim(spaced["gold"], spaced["pred"], pred))


def em_no_space(gold: Column, pred: Column) -> Column:
    """1 when the gold text without whitespace starts at some line of pred (M3)."""
    both = F.struct(tx.squash(gold).alias("gold"), tx.squash(pred).alias("pred"))
    return once(both, lambda squashed: _em_no_space(squashed["gold"], squashed["pred"], pred))


def em_no_comment(gold: Column, pred: Column) -> Column:
    """``em_no_space`` after removing comments from both sides (M4)."""
    both = F.struct(
        tx.remove_comments(gold).alias("gold"), tx.remove_comments(pred).alias("pred")
    )
    return once(both, lambda bare: em_no_space(bare["gold"], bare["pred"]))


def gold_forms(gold: Column) -> dict[str, Column]:
    """The forms of a gold text that the metrics compare with, as named columns."""
    return {
        "_gold_spaced": tx.spaced(gold),
        "_gold_bare_squashed": tx.squash(tx.remove_comments(gold)),
    }


def score_against_forms(df: DataFrame, pred: str = "generation") -> DataFrame:
    """Add the four exact-match columns to rows that carry ``gold_forms``.

    Normalised texts are made once in earlier projections, so no metric repeats them.
    """
    text, bare = F.col(pred), F.col("_pred_bare")
    made = {"_pred_spaced": tx.spaced(text), "_pred_bare": tx.remove_comments(text)}
    # blanks are the only whitespace left in spaced texts
    derived = {
        "_gold_squashed": F.replace("_gold_spaced", F.lit(" "), F.lit("")),
        "_pred_squashed": F.replace("_pred_spaced", F.lit(" "), F.lit("")),
        "_pred_bare_squashed": tx.squash(bare),
    }
    scores = {
        "em": _em(F.col("_gold_spaced"), F.col("_pred_spaced")),
        "em_trim": _em_trim(F.col("_gold_spaced"), F.col("_pred_spaced"), text),
        "em_no_space": _em_no_space(F.col("_gold_squashed"), F.col("_pred_squashed"), text),
        "em_no_comment": _em_no_space(
            F.col("_gold_bare_squashed"), F.col("_pred_bare_squashed"), bare
        ),
    }
    scored = df.withColumns(made).withColumns(derived).withColumns(scores)
    return scored.drop(*made, *derived, "_gold_spaced", "_gold_bare_squashed")


def score_generation(df: DataFrame, gold: str = "gold", pred: str = "generation") -> DataFrame:
    """Add the four exact-match columns (M5)."""
    return score_against_forms(df.withColumns(gold_forms(F.col(gold))), pred)


def token_set(text: Column) -> Column:
    """Distinct words and runs of ASCII letters of a text."""
    return F.array_union(tx.words(text), F.regexp_extract_all(text, F.lit("[a-zA-Z]+"), F.lit(0)))


def jaccard(left: Column, right: Column) -> Column:
    """Shared over united size of two texts' token sets, 0 when both are empty (M6)."""
    both = F.struct(token_set(left).alias("left"), token_set(right).alias("right"))

    def similarity(sets: Column) -> Column:
        shared = F.size(F.array_intersect(sets["left"], sets["right"]))
        united = F.size(sets["left"]) + F.size(sets["right"]) - shared
        return F.when(united == 0, F.lit(0.0)).otherwise(shared / united)

    return once(both, similarity)


def matching_answers(left: Column, right: Column) -> Column:
    """How many positions agree, up to the end of the shorter list (M7)."""
    shorter = F.least(F.size(left), F.size(right))
    pairs = F.zip_with(
        F.slice(left, F.lit(1), shorter),
        F.slice(right, F.lit(1), shorter),
        lambda a, b: a.eqNullSafe(b),
    )
    return F.size(F.filter(pairs, lambda same: same))
