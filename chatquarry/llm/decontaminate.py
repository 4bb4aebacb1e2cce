"""Benchmark decontamination by template canonicalisation, by DataFrame functions only.

Numbers, the units after them and names become typed placeholders, case and punctuation go; windows of the templates
are joined by hash, and where the words around agree the slots' values must map consistently, so that a question with
other numbers is caught and a chance likeness is not. Copies whose template differs only because of capitals are found
by windows of the words as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.base import let
from ._shared import Scratch, bounded, kind_of, table

#: Private-use characters: the first three begin a slot's token, the others end a number and other slots while they are
#: marked in a text. Texts lose those of their own first.
NUM, UNIT, NAME, _NUM_END, _END = "\ue000", "\ue001", "\ue002", "\ue003", "\ue004"
#: Units that count as slots after a number.
UNITS = "km|cm|mm|m|mi|ft|in|kg|mg|g|lb|oz|ml|l|hours?|hrs?|h|minutes?|mins?|seconds?|secs?|s|days?|weeks?|months?|years?|dollars?|euros?|cents?|percent|meters?|metres?|miles?|feet|inches|grams?|pounds?|liters?|litres?"
#: Capitalised words that are no names: those that begin sentences, questions above all.
STARTERS = (
    "a|about|after|all|although|an|and|any|are|as|at|because|before|both|but|by|calculate|can|compute|could|did|do|does|during|each|either|every|evaluate|explain|express|few|find|first|for|from|"
    "given|had|has|have|he|her|here|his|how|however|i|if|in|into|is|it|its|let|list|many|more|most|my|name|next|no|not|now|of|on|once|one|only|or|our|over|prove|she|show|since|so|solve|some|"
    "state|suppose|that|the|their|then|there|these|they|this|those|though|to|two|under|until|was|we|were|what|when|where|which|while|who|whose|why|will|with|would|write|you|your"
)
#: Tokens of a window, and how many of them must be words.
WINDOW, WORDS = 8, 5
#: Share of an item's windows that must be found, or their number.
COVERAGE, ENOUGH = 0.5, 20
#: Tokens that an item needs to be searched as it is within texts; a shorter one must be a whole line or sentence.
LONG_ENOUGH = 4
#: Of an item as it is, all windows of PART tokens are known; of a text those at every STEP-th token are looked up. A text
#: that holds PART + STEP - 1 tokens in a row has one of theirs; shorter items are one window, looked up at every token.
PART, STEP = 5, 4

def _by_letter(words: str) -> str:
    """The alternatives of a pattern by their first letter, so that a word is held against few of them."""
    by: dict[str, list[str]] = {}
    for w in words.split("|"):
        by.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{c}(?:{'|'.join(sorted(rest, key=len, reverse=True))})" for c, rest in by.items())


_EDGE = r"(?![\p{L}\p{N}])"
_NUMBER = rf"(?=[0-9])(?<![\p{{L}}\p{{N}}])[0-9]+(?:[.,:/][0-9]+)*(?=(?:(?:{UNITS}){_EDGE})|{_EDGE})"
_UNIT = rf"(?<={_NUM_END})\s?({UNITS}){_EDGE}"
_CAPITALISED = rf"(?=\p{{Lu}})(?!(?i:{_by_letter(STARTERS)}){_EDGE})\p{{Lu}}\p{{L}}*+(?:['’-]\p{{L}}++)*+"
_NAME = rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{N}}]){_CAPITALISED}(?: {_CAPITALISED})*+"


_TOKEN = rf"[{NUM}-{NAME}][^{_NUM_END}{_END}]*+|[\p{{L}}\p{{N}}]++"
_OWN = rf"[{NUM}-{_END}]"


def marked(text: Column) -> Column:
    """The tokens of a text in lower case, array<string>: words as they are, slots as NUM, UNIT or NAME and their value.

    Slots are set between marks in the text, and all tokens are taken in one pass. Only letters and digits are parts
    of words; empty for null and for texts without words.
    """
    own = lambda t: F.when(t.rlike(_OWN), F.regexp_replace(t, _OWN, " ")).otherwise(t)
    numbers = lambda t: F.when(t.rlike("[0-9]"), F.regexp_replace(t, _NUMBER, f"{NUM}$0{_NUM_END}")).otherwise(t)
    units = lambda t: F.when(F.contains(t, F.lit(_NUM_END)), F.regexp_replace(t, _UNIT, f"{UNIT}$1{_END}")).otherwise(t)
    names = lambda t: F.regexp_replace(t, _NAME, f"{NAME}$0{_END}")
    found = let(F.coalesce(text, F.lit("")), lambda t: let(own(t), lambda t: let(numbers(t), lambda t: F.regexp_extract_all(names(units(t)), F.lit(_TOKEN), F.lit(0)))))
    return F.transform(found, F.lower)


def is_slot(token: Column, *marks: str) -> Column:
    """Whether a token of marked() is a slot, one of the given kinds if there are some."""
    if marks:
        return F.left(token, F.lit(1)).isin(*marks)
    return (token >= NUM) & (token < _NUM_END)


def typed(token: Column) -> Column:
    """A token as it stands in the template: slots without their value."""
    return F.when(is_slot(token), F.left(token, F.lit(1))).otherwise(token)


def _split(flat: Column, none: str) -> Column:
    """The words of a text between single spaces, in lower case; none where the text doesn't match.

    Words are lowered one by one, since those in ASCII take a much faster way than a text with one other letter.
    """
    return let(F.trim(flat), lambda x: F.when(x.rlike(none), F.transform(F.split(x, " "), F.lower)).otherwise(F.array().cast("array<string>")))


def plain(text: Column) -> Column:
    """The words, numbers and operators of a text as they are, in lower case: array<string>, empty where it has no letter or digit."""
    signs = F.regexp_replace(F.coalesce(text, F.lit("")), r"([-+*/=<>^%×÷−])", " $1 ")
    return _split(F.regexp_replace(signs, r"[^\p{L}\p{N}+*/=<>^%×÷−-]++", " "), r"[\p{L}\p{N}]")


def _word_count(tokens: Column) -> Column:
    return F.size(F.filter(tokens, lambda t: ~is_slot(t)))


_WINDOWS = "array<struct<h:bigint,place:int>>"


def _windows(tokens: Column, widths: list[int], form: Callable[[Column], Column] = lambda t: t) -> Column:
    """All windows of the forms of a list of tokens, of every width: array<struct<h, place>>; the width is part of the hash.

    Narrower windows come first, each width's by place. Tokens are hashed once; two hashes of a power of two of tokens make that of twice as many, and two that overlap
    make that of any number between.
    """
    top = max(widths, default=1)

    def pair(low: Column, by: int, width: int) -> Column:
        return F.zip_with(low, F.slice(low, F.lit(by + 1), F.size(low)), lambda x, y: F.xxhash64(F.lit(width), x, y))

    def of(low: Column, size: int, n: Column) -> Column:
        """The windows whose widths are from `size` to less than twice that, and those of larger widths."""
        now = [w for w in widths if size <= w < 2 * size]
        each = [F.transform(F.slice(low if w == size else pair(low, w - size, w), F.lit(1), F.greatest(n - (w - 1), F.lit(0))), lambda h, i: F.struct(h.alias("h"), (i + 1).alias("place"))) for w in now]
        if 2 * size <= top:
            each.append(let(pair(low, size, 2 * size), lambda twice: of(twice, 2 * size, n)))
        return F.concat(*each)

    first = F.transform(tokens, lambda t: F.xxhash64(F.lit(1), form(t)))
    return F.coalesce(let(first, lambda h: of(h, 1, F.size(h))), F.array().cast(_WINDOWS)) if widths else F.array().cast(_WINDOWS)


def _parts(tokens: Column, step: int) -> Column:
    """The windows of PART tokens at every step-th token, like _windows(), with other hashes."""
    at = lambda t: F.when(F.size(t) >= PART, F.sequence(F.lit(1), F.size(t) - (PART - 1), F.lit(step))).otherwise(F.array().cast("array<int>"))
    return let(tokens, lambda t: F.transform(at(t), lambda i: F.struct(F.xxhash64(F.lit(-1), F.slice(t, i, PART)).alias("h"), i.alias("place"))))


def _key(ident: Column, text: Column) -> Column:
    """What names a document: its id, or its text where it has none."""
    return F.when(ident.isNotNull(), F.concat(F.lit("i"), ident.cast("string"))).otherwise(F.concat(F.lit("t"), F.md5(F.coalesce(text, F.lit("")))))


def _entire(scratch: Scratch, texts: DataFrame, found: DataFrame, items: DataFrame) -> DataFrame:
    """Those (doc, key) of found where all words, numbers and operators of the item stand in a row in the text.

    An item of under LONG_ENOUGH of them must be a whole line or sentence. A document is read once for all its items.
    """
    joined = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
    wanted = items.select("key", joined("plain").alias("needle"), (F.size("plain") < LONG_ENOUGH).alias("short"))
    wanted = found.select("doc", "key").distinct().join(bounded(wanted), "key").groupBy("doc").agg(F.collect_list(F.struct("key", "needle", "short")).alias("asked"))
    lines = F.transform(F.split("text", r"[\n\r]+|(?<=[.!?:;])\s+"), lambda x: joined(plain(x)))
    about = texts.join(bounded(scratch.keep(wanted, "asked")), "doc").withColumns({"whole": joined(plain(F.col("text"))), "lines": F.when(F.exists("asked", lambda a: a.short), lines)}).drop("text")
    held = F.filter("asked", lambda a: F.when(a.short, F.array_contains("lines", a.needle)).otherwise(F.contains("whole", a.needle)))
    return about.select("doc", F.explode(held).alias("a")).select("doc", "a.key").distinct()


def _judged(scratch: Scratch, hits: DataFrame, total: DataFrame, bench: DataFrame, texts: DataFrame, coverage: float, enough: int) -> DataFrame:
    """(doc, key, found, windows, verbatim) of the windows found, where the coverage is reached and the slots fit."""
    reached = lambda n: (n >= coverage * F.col("windows")) | (n >= enough)
    found = hits.groupBy("doc", "key").agg(F.countDistinct("at").alias("found"))
    found = found.join(bounded(total), "key").where(reached(F.col("found")))
    shifts = hits.groupBy("doc", "key", "shift").agg(F.count(F.lit(1)).alias("n")).groupBy("doc", "key").agg(F.max("n").alias("most"), F.collect_list(F.struct("n", F.col("shift").cast("int").alias("shift"))).alias("all"))
    tried = F.filter("all", lambda p: reached(p.n) | (p.n == F.col("most")))
    found = scratch.keep(found.join(shifts, ["doc", "key"]).select("doc", "key", "found", "windows", (F.col("most") == F.col("windows")).alias("entire"), tried.alias("shifts")), "found")
    slotted = bench.where(F.exists("tokens", lambda t: is_slot(t))).select("key", "tokens")
    asked = scratch.keep(found.join(bounded(slotted.select("key")), "key", "left_semi"), "asked")
    theirs = texts.join(bounded(asked.select("doc").distinct()), "doc", "left_semi").select("doc", marked(F.col("text")).alias("theirs"))
    pairs = asked.join(slotted, "key").join(theirs, "doc")

    def inner(i: Column, a: Column, b: Column) -> Column:
        """Of a name at the item's edge, the words next to the item: beyond them the document's own names run on."""
        parts, n = F.split(F.substr(b, F.lit(2)), " "), F.size(F.split(a, " "))
        longer = F.size(parts) > n
        first, last = i == 0, i == F.size("tokens") - 1
        words = lambda some: F.concat(F.lit(NAME), F.array_join(some, " "))
        return F.when(longer & first, words(F.slice(parts, -n, n))).when(longer & last, words(F.slice(parts, F.lit(1), n))).otherwise(b)

    def mapped(mark: str, shift: Column, value: Callable[[Column, Column, Column], Column] = lambda i, a, b: b) -> Column:
        """The distinct pairs of values of one kind at a place."""
        ours, theirs = lambda i: F.get("tokens", i), lambda i: F.get("theirs", i + shift)
        here = F.filter(F.sequence(F.lit(0), F.size("tokens") - 1), lambda i: is_slot(ours(i), mark) & F.coalesce(is_slot(theirs(i), mark), F.lit(False)))
        return F.array_distinct(F.transform(here, lambda i: F.struct(ours(i).alias("a"), value(i, ours(i), theirs(i)).alias("b"))))

    kinds = (("num", NUM), ("unit", UNIT), ("name", NAME))
    pairs = pairs.withColumn("maps", F.transform("shifts", lambda s: F.struct(*[mapped(mark, s.shift).alias(kind) for kind, mark in kinds], mapped(NAME, s.shift, inner).alias("inner"), (s.n == F.col("windows")).alias("entire"))))
    consistent = lambda c: F.size(c) == F.size(F.array_distinct(F.transform(c, lambda p: p.a)))
    same = lambda c: F.forall(c, lambda p: p.a == p.b)
    fits = F.exists("maps", lambda m: consistent(m.num) & consistent(m.unit) & (consistent(m["name"]) | consistent(m.inner)))
    equal = F.exists("maps", lambda m: m.entire & same(m.num) & same(m.unit) & same(m.inner))
    judged = pairs.select("doc", "key", fits.alias("fits"), equal.alias("same"))
    judged = judged.groupBy("doc", "key").agg(F.bool_or("fits").alias("fits"), F.bool_or("same").alias("same"))
    out = found.join(judged, ["doc", "key"], "left").where(F.coalesce("fits", F.lit(True)))
    return out.select("doc", "key", "found", "windows", F.coalesce("same", "entire").alias("verbatim"))


def _matches(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, window: int, words: int, coverage: float, enough: int) -> DataFrame:
    """matches() with a document's key in place of its id."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "templates")
    given = items.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("string").alias("text")).where("text is not null").distinct()
    every = given.select("text").distinct().select("text", F.monotonically_increasing_id().alias("key"), marked(F.col("text")).alias("tokens"), plain(F.col("text")).alias("plain"))
    every = scratch.keep(every, "items")
    bench = every.select("key", "tokens").where(F.size("tokens") >= words)
    shorter = bench.where(F.size("tokens") < window)
    widths = sorted(r[0] for r in shorter.select(F.size("tokens")).distinct().collect())
    # an item of under `window` tokens is one window, the first of its width
    one = F.get(F.filter(_windows(F.col("tokens"), widths, typed), lambda w: w.place == 1), F.array_position(F.lit(widths), F.size("tokens")).cast("int") - 1)
    wide = F.filter(_windows(F.col("tokens"), [window], typed), lambda w: _word_count(F.slice("tokens", w.place, window)) >= words)
    known = [bench.where(F.size("tokens") >= window).select("key", F.lit(False).alias("as_is"), F.explode(wide).alias("w"))]
    if widths:
        known.append(shorter.where(_word_count(F.col("tokens")) >= words).select("key", F.lit(False).alias("as_is"), one.alias("w")))
    if not bench.isEmpty():
        widths.append(window)
    asked = every.select("key", "plain").where(F.size("plain") > 0)
    lengths = sorted(r[0] for r in asked.select(F.size("plain")).where(F.size("plain") < PART + STEP - 1).distinct().collect())
    first = F.get(F.filter(_windows(F.col("plain"), lengths), lambda w: w.place == 1), F.array_position(F.lit(lengths), F.size("plain")).cast("int") - 1)
    known.append(asked.where(F.size("plain") >= PART + STEP - 1).select("key", F.lit(True).alias("as_is"), F.explode(_parts(F.col("plain"), 1)).alias("w")))
    if lengths:
        known.append(asked.where(F.size("plain") < PART + STEP - 1).select("key", F.lit(True).alias("as_is"), first.alias("w")))
    known = scratch.keep(reduce(DataFrame.unionByName, known).select("key", "as_is", (F.col("w.place") - 1).alias("at"), "w.h"), "windows")
    total = known.where("not as_is").groupBy("key").agg(F.count(F.lit(1)).alias("windows"))
    texts = docs.select(_key(F.col(id_col), F.col(text_col).cast("string")).alias("doc"), F.col(text_col).cast("string").alias("text"))
    as_is = let(plain(F.col("text")), lambda p: F.concat(_parts(p, STEP), _windows(p, lengths)))
    places = texts.select("doc", F.explode(F.concat(_windows(marked(F.col("text")), widths, typed), as_is)).alias("w")).select("doc", "w.h", "w.place")
    hits = places.join(bounded(known), "h").select("doc", "key", "as_is", "at", (F.col("place") - 1 - F.col("at")).alias("shift"))
    hits = scratch.keep(hits.groupBy("doc", "key", "as_is", "shift", "at").count().drop("count"), "hits")
    out = _judged(scratch, hits.where("not as_is"), total, bench, texts, coverage, enough)
    one = F.coalesce("windows", F.lit(1)).cast("long")
    entire = _entire(scratch, texts, hits.where("as_is"), asked).join(bounded(total), "key", "left").select("doc", "key", one.alias("found"), one.alias("windows"), F.lit(True).alias("verbatim"))
    out = out.unionByName(scratch.keep(entire, "whole")).join(bounded(given.join(every, "text").select("key", "item")), "key")
    most = F.max(F.struct((F.col("found") / F.col("windows")).alias("share"), "found", "windows")).alias("most")
    out = out.groupBy("doc", "item", F.when(F.col("item").isNull(), F.col("key")).alias("nameless")).agg(most, F.bool_or("verbatim").alias("verbatim"))
    return scratch.keep(out.select("doc", "item", "most.found", "most.windows", "verbatim"), "matches")


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, words: int = WORDS, coverage: float = COVERAGE, enough: int = ENOUGH) -> DataFrame:
    """(doc, text_md5, item, found, windows, verbatim) for every document that holds an item, as it is or with other slots.

    An item is held if `coverage` of its windows (or `enough` of them) are found in the document's template and the
    slots of a place map consistently: equal values of the item to equal values of the document, for numbers, units
    and names apart. A name at the item's edge that runs on into names of the document counts whole or by the words
    next to the item, whichever is consistent. Every place is tried that reaches the coverage by itself or, of an item found in parts, holds
    the most windows. Windows of fewer than `words` words don't count. An item of fewer tokens than a window is one
    window of its own length, if it has `words` words. Any item is
    held, too, where all its words, numbers and operators stand in a row as they are, in capitals or not: one without
    a window that counts is held only there, since so few words are no evidence of a copy with other slots. One of
    under LONG_ENOUGH of these must be a whole line or sentence of the document, since a word or two say nothing
    within one. Only items without a letter or digit are not searched.
    verbatim says that the item stands there as it is, or that at one place all windows are found and all slots are
    equal. Marks, tags and signs between words don't count, nor do characters of the private use area. Null and empty texts hold nothing;
    documents that repeat an id count together, each text without an id is a document of its own: its row has a null
    doc and the text's MD5, which is null for the others. Ids may have any type.
    Every distinct text of the items is searched by itself and mapped back to its ids at the end, so rows that repeat
    count once; an item of several texts is held if one of them is, and has the figures of the one found most. Each
    item text without an id is an item of its own, whose row has a null item. An empty table on either side gives no
    rows; other columns are ignored, whatever their names.
    Items go to all executors if their windows are few enough, measured; else the windows are joined by a shuffle.
    """
    found = _matches(docs, items, id_col, text_col, item_col, item_text_col, window, words, coverage, enough)
    nameless = F.startswith("doc", F.lit("t"))
    of = F.when(~nameless, F.substr("doc", F.lit(2))).cast(kind_of(docs, id_col)).alias("doc")
    return found.select(of, F.when(nameless, F.substr("doc", F.lit(2))).alias("text_md5"), "item", "found", "windows", "verbatim")


def _options(options: dict) -> dict:
    return dict(text_col="text", item_col="item_id", item_text_col="text", window=WINDOW, words=WORDS, coverage=COVERAGE, enough=ENOUGH) | options


def flag(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document: id_col, contaminated boolean, n_items long, item_ids array, verbatim boolean.

    See matches(). verbatim is false where no item found stands there as it is, null where none is found. Items
    without an id count in n_items and have no entry in item_ids. A document without an id is judged by its text.
    """
    options = _options(options)
    found = _matches(docs, items, id_col, **options)
    about = Scratch(docs.sparkSession, "templates").keep(found.groupBy("doc").agg(F.count(F.lit(1)).alias("n_items"), F.sort_array(F.collect_set("item")).alias("item_ids"), F.bool_or("verbatim").alias("verbatim")), "about")
    rows = docs.select(F.col(id_col).alias("id"), _key(F.col(id_col), F.col(options["text_col"]).cast("string")).alias("doc"))
    out = rows.join(bounded(about), "doc", "left")
    none = F.array().cast(f"array<{kind_of(items, options['item_col'])}>")
    return out.select(F.col("id").alias(id_col), F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("item_ids", none).alias("item_ids"), "verbatim")


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without the documents that hold an item, those without an id by their texts; see matches().

    All rows of an id go with it; null and empty texts, and rows that repeat, stay unless their document is held. An
    empty table of items leaves docs as it is. Columns are those of docs, whatever their names.
    """
    options = _options(options)
    found = Scratch(docs.sparkSession, "templates").keep(_matches(docs, items, id_col, **options).select(F.col("doc").alias("held")).distinct(), "held")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), _key(F.col(id_col), F.col(options["text_col"]).cast("string")).alias("key"))
    return rows.join(bounded(found), F.col("key") == F.col("held"), "left_anti").select("doc.*")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
