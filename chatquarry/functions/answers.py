"""Normal forms of final answers, and when two answers are equivalent. Native columns throughout."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import DIGIT, SPACE, let, replace_all, strip
from .boxed import score_answer

# Which literals the normal form replaces and removes, in this order.
SUBSTITUTED = [
    ("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""), ("mbox", "text"), (",\\text{and}", ","),
    ("\\text{and}", ","), ("\\text{m}", "\\text{}"), ("\\le", "<"),
]
REMOVED = [
    "square", "ways", "integers", "dollars", "mph", "inches", "ft", "hours", "km", "units", "\\ldots", "sue", "points",
    "feet", "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds", "meters", "meals", "edges", "students",
    "childrentickets", "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}",
    "\\text{}", "\\mathrm{th}", "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots", "\n", "\r", "\f",
]
#: Commands whose argument replaces them, and texts after (or in) which the answer stands; the last match counts (fixed values).
UNWRAPPED = [r"(?d)\\text\{\((.*?)\)\}", r"(?d)\\text\{(.*?)\}", r"(?d)\\textbf\{(.*?)\}", r"(?d)\\overline\{(.*?)\}", r"(?d)\\boxed\{(.*)\}"]
FOUND_IN = [r"(?d)finalansweris(.*)", r"(?d)answer?is:?(.*)", r"(?d)oxed\{(.*?)\}", r"(?d)\$(.*?)\$"]


def _last_match(s: Column, pattern: str) -> Column:
    return let(s, lambda c: F.coalesce(F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), 1), F.lit(-1)), c))


def normal_form(answer: Column) -> Column:
    """The normal form of a final answer; null stays null."""
    s = replace_all(answer, SUBSTITUTED + [(x, "") for x in REMOVED])
    s = reduce(lambda c, p: F.regexp_replace(c, p, "$1"), UNWRAPPED, s)
    for pattern in FOUND_IN:
        s = _last_match(s, pattern)
    s = let(strip(s), lambda c: F.when(F.contains(c, F.lit("rac")) & ~F.contains(c, F.lit("\\frac")), F.replace(c, F.lit("rac"), F.lit("\\frac"))).otherwise(c))
    s = F.regexp_replace(s, r"(?d)frac([^{])(.)", "frac{$1}{$2}")
    s = F.replace(F.regexp_replace(s, "sqrt([^{])", "sqrt{$1}"), F.lit("$"), F.lit(""))
    return let(s, lambda c: let(F.replace(c, F.lit(","), F.lit("")), lambda d: F.when(d.rlike(rf"\A[{DIGIT}]+\z"), d).otherwise(c)))


def full_fractions(s: Column) -> Column:
    """\\frac12 as \\frac{1}{2}; the whole string stays as it is if a piece after \\frac without a brace has under two characters."""
    piece = lambda p: (
        F.when(p.startswith("{"), p)
        .when(F.substr(p, F.lit(2), F.lit(1)) == "{", F.concat(F.lit("{"), F.left(p, F.lit(1)), F.lit("}"), F.substr(p, F.lit(2))))
        .otherwise(F.concat(F.lit("{"), F.left(p, F.lit(1)), F.lit("}{"), F.substr(p, F.lit(2), F.lit(1)), F.lit("}"), F.substr(p, F.lit(3))))
    )
    parts = lambda x: F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0)))
    bad = lambda x: F.exists(parts(x), lambda p: ~p.startswith("{") & (F.length(p) < 2))
    whole = lambda x: F.array_join(F.concat(F.slice(x, 1, 1), F.transform(parts(x), piece)), "\\frac")
    return let(s, lambda c: let(F.split(c, r"\\frac", -1), lambda x: F.when(bad(x), c).otherwise(whole(x))))


#: Literals that the stripped form replaces: before units are dropped, after, and once infinity is settled (fixed values).
EARLY = [("\\!", ""), ("\\ ", ""), ("\\\\", "\\"), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", "")]
LATER = [("^{\\circ}", ""), ("^\\circ", ""), ("\\$", ""), ("$", ""), ("\\text", ""), ("x\\in", ""), ("\\%", ""), ("%", ""), (" .", " 0."), ("{.", "{0."), ("\\cdot", ""), ("infinity", "\\infty")]


def stripped_form(answer: Column) -> Column:
    """The answer without units, spacing, signs and short forms that don't change its value; null stays null."""
    s = F.regexp_replace(F.replace(strip(answer), F.lit("\n"), F.lit("")), r"\.+\z", "")
    s = replace_all(s, EARLY)
    s = let(s, lambda c: let(strip(F.regexp_replace(c, r"(?d)\\text\{.*?\}$", "")), lambda u: F.when(u != "", u).otherwise(c)))
    s = replace_all(s, LATER)
    s = let(s, lambda c: F.when(F.contains(c, F.lit("\\infty")), c).otherwise(F.replace(c, F.lit("inf"), F.lit("\\infty"))))
    s = replace_all(s, [("+\\inity", "\\infty"), ("and", ""), ("\\mathbf", "")])
    s = replace_all(F.regexp_replace(s, r"(?d)\\mbox\{.*?\}", ""), [("'", ""), ('"', "")])
    s = let(s, lambda c: F.when(F.contains(c, F.lit("j")) & ~F.contains(c, F.lit("i")), F.replace(c, F.lit("j"), F.lit("i"))).otherwise(c))
    s = F.regexp_replace(F.regexp_replace(s, r"(\p{Nd}+)\.0+(\P{Nd})", "$1$2"), r"(?d)(\p{Nd}+)\.0+$", "$1")
    s = let(s, lambda c: F.when(c.startswith("."), F.concat(F.lit("0"), c)).otherwise(c))
    s = let(s, lambda c: let(F.split(c, "=", -1), lambda p: F.when((F.size(p) == 2) & (F.length(F.get(p, F.lit(0))) <= 2), F.get(p, F.lit(1))).otherwise(c)))
    s = F.replace(F.regexp_replace(s, r"(?U)\\sqrt(\w+)", r"\\sqrt{$1}"), F.lit(" "), F.lit(""))
    s = let(full_fractions(s), lambda c: F.when(c == "0.5", F.lit("\\frac{1}{2}")).otherwise(c))
    return F.regexp_replace(s, r"\A(0|-?[1-9][0-9]*)/(0|-?[1-9][0-9]*)\z", r"\\frac{$1}{$2}")


def settled(a: Column, b: Column, other: Column) -> Column:
    """Whether two answers are equivalent: equal texts are, two nulls too, different numbers of ASCII digits, which are
    their own normal forms, aren't; `other` says so for the rest. a and b are used many times and must be columns or bound."""
    number = lambda c: c.rlike(r"\A[0-9]+\z")
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).when(a == b, F.lit(True)).when(number(a) & number(b), F.lit(False)).otherwise(other)


def equivalent(a: Column, b: Column) -> Column:
    """Equal in one of three normal forms, or as they are; two nulls are equivalent, one is not. Cheapest test first."""
    stripped = lambda x, y: (x == y) | (normal_form(x) == normal_form(y))
    pair = F.struct(a.alias("a"), b.alias("b"))
    forms = lambda p: let(F.struct(stripped_form(p.a).alias("x"), stripped_form(p.b).alias("y")), lambda s: stripped(s.x, s.y)) | (normal_form(p.a) == normal_form(p.b))
    return let(pair, lambda p: settled(p.a, p.b, forms(p)))


def choice_gold(gold: Column) -> Column:
    """The gold answer is a single letter."""
    return F.upper(strip(gold)).rlike(r"\A[A-Z]\z")


def choice_label(text: Column) -> Column:
    """The letter a text chooses: the text is a letter, in brackets or with a stop; or has just one letter standing alone."""
    whole, alone = r"\A\(?([A-Z])\)?[.)]?\z", r"(?U)\b([A-Z])\b"
    return let(F.upper(strip(text)), lambda t: F.when(t.rlike(whole), F.regexp_extract(t, whole, 1)).otherwise(let(F.regexp_extract_all(t, F.lit(alone), 1), lambda m: F.when(F.size(m) == 1, F.get(m, F.lit(0))))))


def direct_answer(text: Column) -> Column:
    """The text without white space around it and without "the final answer is:" before it."""
    return strip(F.regexp_replace(strip(text), rf"(?i)\A(?:the[{SPACE}]+)?(?:final[{SPACE}]+)?answer[{SPACE}]*(?:is|:)[{SPACE}]*", ""))


#: ASCII punctuation and the space, as the inside of a class.
_PUNCT = r"""!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~ """


def direct_key(text: Column) -> Column:
    """The form in which direct answers are compared: case folded, no punctuation around, white space collapsed."""
    folded = F.replace(F.lower(direct_answer(text)), F.lit("ß"), F.lit("ss"))
    return F.regexp_replace(F.regexp_replace(strip(folded), rf"\A[{_PUNCT}]+|[{_PUNCT}]+\z", ""), rf"[{SPACE}]+", " ")


def aliases(gold: Column) -> Column:
    """The gold answers of a direct question: the elements of a JSON list, a JSON string's value, else the text itself."""
    listed = F.from_json(gold, "array<string>")
    quoted = F.get(F.from_json(F.concat(F.lit("["), gold, F.lit("]")), "array<string>"), F.lit(0))
    return F.when(strip(gold).startswith("[") & listed.isNotNull(), listed).when(strip(gold).rlike(r'(?s)\A".*"\z') & quoted.isNotNull(), F.array(quoted)).otherwise(F.array(gold))


def extract(text: Column, method: str, gold: Column) -> Column:
    """The answer that a benchmark's method reads from a completion: boxed, exact, knowledge, or (any other) box or text."""
    if method == "boxed":
        return score_answer(text)
    if method == "exact":
        return strip(text)
    found = F.coalesce(score_answer(text), strip(text))
    if method == "knowledge":
        return let(found, lambda c: F.when(choice_gold(gold), choice_label(c)).otherwise(direct_answer(c)))
    return found


def correct(extracted: Column, gold: Column, method: str) -> Column:
    """Whether an extracted answer is right by the method; a null answer never is."""
    if method == "knowledge":
        right = F.when(choice_gold(gold), F.upper(extracted) == F.upper(strip(gold))).otherwise(F.exists(aliases(gold), lambda a: direct_key(a) == direct_key(extracted)))
    else:  # equal texts are right, different whole numbers wrong; only other pairs need their normal forms
        number = lambda c: c.rlike(r"\A[0-9]+\z")
        right = F.when(extracted == gold, F.lit(True)).when(number(extracted) & number(gold), F.lit(False)).otherwise(equivalent(normal_form(extracted), normal_form(gold)))
    return F.when(extracted.isNull(), F.lit(False)).otherwise(F.coalesce(right, F.lit(False)))
