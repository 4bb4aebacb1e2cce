"""The three extractors of boxed answers, and the removal of a preamble before a box. All are native columns.

They differ by intent: `score_*` counts every brace and knows \\fbox, `split_box` skips escaped characters and keeps
the text before the box, `level_box` needs the brace to follow at once. None falls back to an earlier box.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import SPACE, let, rstrip


BOX, FBOX = "\\boxed", "\\fbox"


#: What a pair of braces holds up to three deep, without backtracking: all braces count, or a backslash hides the next character.
_PLAIN = r"[^{}]*+(?:\{[^{}]*+(?:\{[^{}]*+\}[^{}]*+)*+\}[^{}]*+)*+"
_ESCAPED = _PLAIN.replace("[^{}]*+", r"(?:[^{}\\]|\\.)*+")


def _closing(text: Column, depth: int, escapes: bool) -> Column:
    """Characters up to the brace that closes the outermost one, it included; null if none does.

    depth is what the text starts at: 0 before a command and its brace, 1 behind it. Braces three deep are matched at
    once; only deeper ones, and those that don't close, are folded over.
    """
    before = r"[^{}]*+\{" if depth == 0 else ""
    whole = rf"(?s)\A({before}{_ESCAPED if escapes else _PLAIN}\}})"
    return let(F.regexp_extract(text, whole, 1), lambda m: F.when(m != "", F.length(m)).otherwise(_folded(text, depth, escapes)))


def _folded(text: Column, depth: int, escapes: bool) -> Column:
    """As _closing(), for any depth: a fold over the pieces that end with a brace (and, with escapes, with a backslash)."""
    ends = r"(?<=[{}\\])" if escapes else r"(?<=[{}])"
    step = lambda s, p: F.when(s.done, s).otherwise(
        let(
            F.right(p, F.lit(1)),
            lambda c: let(
                s.depth + F.when(s.skip & (F.length(p) == 1), 0).when(c == "{", 1).when(c == "}", -1).otherwise(0),
                lambda d: F.struct(
                    d.alias("depth"), (s.n + F.length(p)).alias("n"), (F.lit(escapes) & (c == "\\") & ~(s.skip & (F.length(p) == 1))).alias("skip"),
                    ((c == "}") & (d == 0) & (d < s.depth)).alias("done"),
                ),
            ),
        )
    )
    start = F.struct(F.lit(depth).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("skip"), F.lit(False).alias("done"))
    return F.aggregate(F.split(text, ends), start, step, lambda s: F.when(s.done, s.n))


def _after_last(text: Column, marker: str) -> Column:
    return F.substring_index(text, marker, -1)


def score_span(text: Column) -> Column:
    """The last \\boxed{...} of the text, else the last \\fbox{...}, with its command; null if none or unbalanced."""
    tail = F.when(F.contains(text, F.lit(BOX)), F.concat(F.lit(BOX), _after_last(text, BOX))).when(F.contains(text, F.lit(FBOX)), F.concat(F.lit(FBOX), _after_last(text, FBOX)))
    return let(tail, lambda t: let(_closing(t, 0, False), lambda n: F.when(n.isNotNull(), F.left(t, n))))


def unbox(span: Column) -> Column:
    """The inside of a span that begins with \\boxed{ or \\fbox{ and ends with a brace; else null."""
    inside = lambda s, n: F.substr(s, F.lit(n + 1), F.length(s) - n - 1)
    return let(span, lambda s: F.when(s.endswith("}") & s.startswith(BOX + "{"), inside(s, 7)).when(s.endswith("}") & s.startswith(FBOX + "{"), inside(s, 6)))


def score_answer(text: Column, peel: bool = True) -> Column:
    """The scorer's answer: the inside of the last box; with peel, of one more pair of braces around all of a line.

    A last \\boxed that holds no braces, as nearly all do, is read at once and has nothing to peel.
    """
    plain = F.try_element_at(F.regexp_extract_all(_after_last(text, BOX), F.lit(r"\A\{([^{}]*+)\}"), 1), F.lit(1))
    return F.coalesce(F.when(F.contains(text, F.lit(BOX)), plain), _any_answer(text, peel))


def _any_answer(text: Column, peel: bool) -> Column:
    """score_answer() of a box of any kind."""
    inner = unbox(score_span(text))
    if not peel:
        return inner
    whole = r"(?d)^\{(.*)\}$"
    return let(inner, lambda s: F.when(s.rlike(whole), F.regexp_extract(s, whole, 1)).otherwise(s))


def split_box(text: Column) -> Column:
    """struct<before, inside> of the last \\boxed {...}, white space allowed before the brace; null if none or unbalanced."""
    opens = rf"\A[{SPACE}]*\{{"
    last = rf"(?s)\A(.*)\\boxed[{SPACE}]*\{{(.*)\z"
    # nearly always the last command is the last box; a later one without a brace is looked behind
    rest = _after_last(text, BOX)
    found = F.when(rest.rlike(opens), F.struct(F.left(text, F.length(text) - F.length(rest) - len(BOX)).alias("before"), F.regexp_replace(rest, opens, "").alias("rest")))
    found = F.when(F.contains(text, F.lit(BOX)), F.coalesce(found, F.when(text.rlike(rf"\\boxed[{SPACE}]*\{{"), F.struct(F.regexp_extract(text, last, 1).alias("before"), F.regexp_extract(text, last, 2).alias("rest")))))
    return let(found, lambda p: let(_closing(p.rest, 1, True), lambda n: F.when(n.isNotNull(), F.struct(p.before.alias("before"), F.left(p.rest, n - 1).alias("inside")))))


def level_box(text: Column) -> Column:
    """The inside of the last \\boxed{...} without escapes; null if none or unbalanced."""
    rest = F.when(F.contains(text, F.lit(BOX + "{")), _after_last(text, BOX + "{"))
    return let(rest, lambda r: let(_closing(r, 1, False), lambda n: F.when(n.isNotNull(), F.left(r, n - 1))))


#: Characters at the end of a text that are looked at first, and more than a phrase has: one cut in two leaves fewer.
_TAIL, _LONGEST = 200, 20


def strip_preamble(text: Column) -> Column:
    """Drops delimiters, phrases (after white space or at the start) and white space from the end, however they nest."""
    # the delimiters and phrases are fixed values
    end = rf"(?i)(?:[{SPACE}$]++|\\\[|\\\(|(?:\A|(?<=[{SPACE}]))(?:the answer is:?|final answer:|answer:))+\z"
    cut = lambda t: rstrip(F.regexp_replace(t, end, ""))
    short = lambda t: let(cut(F.right(t, F.lit(_TAIL))), lambda c: F.when(F.length(c) > _LONGEST, F.concat(F.left(t, F.length(t) - _TAIL), c)).otherwise(cut(t)))
    return let(text, lambda t: F.when(F.length(t) > _TAIL, short(t)).otherwise(cut(t)))
