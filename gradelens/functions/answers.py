"""From raw model answers to clean text, letter scores and picked letters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradelens import values as v
from gradelens.functions import text as tx


def clean_generation(content: Column) -> Column:
    """Strip, then drop one opening fence, closing fence, opening tag and closing tag (G1)."""
    cleaned = tx.strip(content)
    for wrapper in (r"^```[^\n]*\n?", r"(?d)\n?```$", r"^\[[^\]]+\]\n?", r"(?d)\n?\[/[^\]]+\]$"):
        cleaned = F.regexp_replace(cleaned, wrapper, "")
    return cleaned


def usual_answer(content: Column) -> Column:
    """Whether the text has the shape of the expected answer object."""
    return F.rlike(content, F.lit(r'^\{\s*"answer"\s*:\s*"[A-D]"\s*\}$'))


def is_json(content: Column) -> Column:
    """Whether the text is exactly one JSON value.

    The expected answer object is recognised by its shape. Anything else must parse both as
    the only element of a list and as the only field of an object, which rules out trailing
    text and several values in a row.
    """
    return F.when(usual_answer(content), F.lit(True)).otherwise(_parses(content))


def _parses(content: Column) -> Column:
    strict = {"allowSingleQuotes": "false"}
    in_list = F.from_json(F.concat(F.lit("["), content, F.lit("]")), "array<string>", strict)
    in_object = F.from_json(
        F.concat(F.lit('{"v":'), content, F.lit("}")), "map<string,string>", strict
    )
    # the parser knows more names of infinity than JSON readers elsewhere do
    bare = F.regexp_replace(content, r'"(?:\\.|[^"\\])*"', '""')
    named = F.rlike(bare, F.lit(r"\+Infinity|INF"))
    return ~named & in_list.isNotNull() & in_object.isNotNull()


def stripped_tokens(tokens: Column) -> Column:
    """Tokens as the letters' scores compare them: without whitespace where that makes a letter of one.

    Lists are searched as one text first; most hold no letter with whitespace at its ends and stay as
    they are.
    """
    letters = f"[{''.join(v.LETTERS)}]"
    padded = rf"(?:^|\x00)(?:{tx.WS}+{letters}{tx.WS}*|{letters}{tx.WS}+)(?:\x00|\z)"
    found = F.rlike(F.array_join(tokens, "\x00"), F.lit(padded))
    return F.when(found, F.transform(tokens, tx.strip)).otherwise(tokens)


def token_scores(logprobs: Column, letters: Sequence[str]) -> Column:
    """Log-probability of the last token equal to each letter, unseen letters at the floor."""
    latest_first = F.reverse(logprobs)
    read = F.struct(
        stripped_tokens(latest_first["token"]).alias("tokens"),
        latest_first["logprob"].alias("scores"),
    )
    bound = F.transform(F.array(read), lambda r: scores_of(r["tokens"], r["scores"], letters))
    return F.get(bound, F.lit(0))


def scores_of(tokens: Column, scores: Column, letters: Sequence[str]) -> Column:
    """Scores of the letters from stripped tokens, latest first; tokens may be read often."""
    return F.array(
        *[
            F.coalesce(
                F.get(scores, (F.array_position(tokens, letter) - 1).cast("int")),
                F.lit(v.UNSEEN_LOGPROB),
            )
            for letter in letters
        ]
    )


def fallback_first_choice(content: Column, scores: Column, letters: Sequence[str]) -> Column:
    """Scores of the answer, or the first letter for empty and non-JSON content."""
    given = F.coalesce(content, F.lit(""))
    return scores_if(valid_content(usual_answer(given), tx.strip(given)), scores, letters)


def valid_content(usual: Column, stripped: Column) -> Column:
    """Whether stripped content counts as an answer; ``usual`` settles most rows before anything is parsed."""
    return F.when(usual, F.lit(True)).otherwise((stripped != "") & _closed(stripped) & is_json(stripped))


def _closed(stripped: Column) -> Column:
    """Whether the text ends as a JSON value with its first character does; what is cut short needs no parser."""
    pairs = [F.startswith(stripped, F.lit(first)) & ~F.endswith(stripped, F.lit(last)) for first, last in ("{}", "[]", '""')]
    return ~(pairs[0] | pairs[1] | pairs[2])


def scores_if(valid: Column, scores: Column, letters: Sequence[str]) -> Column:
    """The scores of valid content, else those of the first letter."""
    first = F.array(
        F.lit(v.FALLBACK_LOGPROB), *[F.lit(v.UNSEEN_LOGPROB) for _ in letters[1:]]
    )
    return F.when(valid, scores).otherwise(first)


def symbol_scores(content: Column, logprobs: Column, letters: Sequence[str]) -> Column:
    """Scores parallel to the letters (G3 with G4)."""
    return fallback_first_choice(content, token_scores(logprobs, letters), letters)


def pick_index(scores: Column) -> Column:
    """Position of the highest score; ties go to the earliest."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def pick_symbol(scores: Column) -> Column:
    """Letter of the highest score; ties go to the earliest letter."""
    return F.get(letter_array(len(v.LETTERS)), pick_index(scores))


def letter_array(count: int) -> Column:
    return F.array(*[F.lit(letter) for letter in v.LETTERS[:count]])


def offered_scores(task: Column, four: Column) -> Column:
    """Four letters' scores with the letters that the task does not offer at the floor.

    A floor score is picked only when all letters are at the floor, and then the earliest is.
    """
    fewer = task.isin([name for name, k in v.OPTION_COUNT.items() if k == 3])
    fourth = F.when(fewer, F.lit(v.UNSEEN_LOGPROB)).otherwise(F.get(four, F.lit(3)))
    return F.array(*[F.get(four, F.lit(i)) for i in range(3)], fourth)
