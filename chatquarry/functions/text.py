"""Normalisers of problems, subjects, levels and names, and tests of a text's form. Native columns throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import DIGIT, SPACE, falsy, let, replace_all, strip

#: Subjects and levels of the levelled problem sets (fixed values).
SUBJECTS = ("Algebra", "Counting & Probability", "Geometry", "Intermediate Algebra", "Number Theory", "Prealgebra", "Precalculus")
LEVELS = ("Level 1", "Level 2", "Level 3", "Level 4", "Level 5")
#: Sources of the olympiad set that are admitted (fixed values).
OLYMPIADS = ("olympiads", "amc_aime", "aops_forum", "synthetic_amc")


def problem_key(text: Column) -> Column:
    """A problem's text for finding repeats: lower case, no TeX spacing or dollar signs, white space collapsed; null is empty."""
    s = replace_all(F.lower(F.coalesce(text, F.lit(""))), [("\\,", ""), ("\\;", ""), ("\\!", ""), ("\\ ", ""), ("$", "")])
    return strip(F.regexp_replace(s, rf"[{SPACE}]+", " "))


def level_of_training(level: Column) -> Column:
    """`Level n` from n or `Level n`; other texts pass, blank is null."""
    return let(strip(level), lambda s: F.when(s == "", None).when(s.rlike(rf"\A[{DIGIT}]+\z"), F.concat(F.lit("Level "), s)).otherwise(s))


def level_of_extraction(level: Column) -> Column:
    """`Level n` from n or `Level n`; anything else, `Level ?` included, is null."""
    known = lambda s: s.startswith("Level ") & ~strip(F.substr(s, F.lit(7))).isin("", "?")
    return let(strip(level), lambda s: F.when(known(s), s).when(s.rlike(rf"\A[{DIGIT}]+\z"), F.concat(F.lit("Level "), s)))


def level_of_test(level: Column) -> Column:
    """`Level ` put before whatever lacks it; empty is null."""
    return F.when(falsy(level).isNull(), None).when(level.startswith("Level "), level).otherwise(F.concat(F.lit("Level "), level))


def subject_of(first: Column, second: Column) -> Column:
    """The first of two subjects that isn't empty, with `&` in the name that has two spellings."""
    return let(F.coalesce(falsy(first), falsy(second)), lambda s: F.when(s == "Counting and Probability", F.lit("Counting & Probability")).otherwise(s))


def subject_slug(subject: Column) -> Column:
    return replace_all(F.lower(strip(subject)), [(" ", "_"), ("&", "and")])


def source_tag(model: Column) -> Column:
    """A column-safe tag from a model's id: what follows the last slash, lower case, `-` and `.` as `_`."""
    return F.translate(F.lower(F.element_at(F.split(model, "/"), -1)), "-.", "__")


def parse_levels(spec: str) -> tuple[str, ...]:
    """("Level 4", "Level 5") from "4,5"; an error on an unknown token or none."""
    found = []
    for token in (t.strip() for t in spec.split(",")):
        if token and (token.isdigit() or (token.startswith("Level ") and token[6:].strip() not in ("", "?"))):
            found.append(token if token.startswith("Level ") else f"Level {token}")
        elif token:
            raise ValueError(f"not a level: {token!r}")
    if not found:
        raise ValueError("no levels given")
    return tuple(found)


def well_formed(text: Column) -> Column:
    """Has a closed think block and the opening of a box."""
    return text.rlike("(?s)<think>.*?</think>") & F.contains(text, F.lit("\\boxed{"))


def token_estimate(text: Column, chars_per_token: int = 4) -> Column:
    """A tokenizer-free count, characters over four, rounded up; a real tokenizer can be passed wherever this is used."""
    return F.ceil(F.length(text) / chars_per_token).cast("int")


#: Completions at least this long are cut off if the end has no box (fixed values).
CUT_TOKENS, TAIL_CHARS = 4090, 800


def failure_mode(repeats: Column, extracted: Column, right: Column, tokens: Column, text: Column) -> Column:
    """repetition, correct, no_box, truncated or wrong_box, the first that holds."""
    tail = F.right(text, F.lit(TAIL_CHARS))
    boxless = ~F.contains(tail, F.lit("\\boxed")) & ~F.contains(tail, F.lit("\\fbox"))
    return F.when(repeats, F.lit("repetition")).when(extracted.isNotNull() & right, F.lit("correct")).when(extracted.isNull(), F.lit("no_box")).when((tokens >= CUT_TOKENS) & boxless, F.lit("truncated")).otherwise(F.lit("wrong_box"))


#: Ways in which a completion fails, in the order in which ties between them are settled (fixed values).
FAILURES = ("no_box", "wrong_box", "truncated", "repetition", "other")
