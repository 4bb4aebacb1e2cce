"""Chat formatting with typed content parts, by DataFrame functions only.

A turn's content is a list of parts: text, image, audio or document. Texts are escaped, other parts become ordered
placeholders whose references and expanded token counts are recorded; turns are marked, assistant texts are masked.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import table

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>\n"
#: Stands for a part that is no text until its placeholder is known: this pair, of which texts can't hold the second
#: after the first, since there the third comes between.
_HOLD, _PART, _TEXT = "\ue000", "\ue001", "\ue002"
#: Strings that texts must not hold as they are: this template's own begin with the first, the rest are other templates'.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: One content part; only the fields of its type are set.
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Tokens that a part expands to: image patches of this side, audio tokens a second, tokens a document page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 14, 25, 256


def _java(literal: str) -> str:
    return re.sub(r"([\\\[\](){}.*+?^$|/<>-])", r"\\\1", literal).replace("\\<", "<").replace("\\>", ">").replace("\\/", "/")


def escape(text: Column) -> Column:
    """Doubles backslashes and puts one after the first character of every control string; unescape() undoes it."""
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    starts = "|".join(f"{_java(c[0])}(?={_java(c[1:])})" for c in CONTROL)
    return F.regexp_replace(doubled, f"({starts})", r"$1\\")


def unescape(text: Column) -> Column:
    marks = "|".join(rf"(?<={_java(c[0])})\\(?={_java(c[1:])})" for c in CONTROL)
    return F.replace(F.regexp_replace(text, marks, ""), F.lit("\\\\"), F.lit("\\"))


def _tokens(p: Column) -> Column:
    image = F.ceil(F.coalesce(p.width, F.lit(0)) / PATCH) * F.ceil(F.coalesce(p.height, F.lit(0)) / PATCH)
    return F.when(p.type == "image", image).when(p.type == "audio", F.ceil(F.coalesce(p.seconds, F.lit(0.0)) * AUDIO_RATE)).when(p.type == "document", F.coalesce(p.pages, F.lit(0)) * PAGE_TOKENS).otherwise(0).cast("long")


def text_parts(text: Column) -> Column:
    """Plain text as a list of one text part; null is empty text."""
    fields = "text|ref|width|height|seconds|pages"
    kinds = dict(text="string", ref="string", width="int", height="int", seconds="double", pages="int")
    return F.array(F.struct(F.lit("text").alias("type"), *[(F.coalesce(text, F.lit("")) if f == "text" else F.lit(None).cast(kinds[f])).alias(f) for f in fields.split("|")]))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_col, n_turns long, formatted string, loss array<struct<start, n>>, attachments.

    formatted is TURN role SAYS content END for each turn, in order of turn_col (null first), then role and content;
    rows that repeat are turns of their own. Texts that follow each other within a turn are joined before they are
    escaped, so that no control string comes about between them. loss has the start (from 1) and length, in code points of formatted, of
    each loss_role content. attachments is array<struct<position, turn, type, ref, tokens>> in order; the part stands
    in formatted as `<|type:position|>`, with % and | of the type as %25 and %7C, and control strings in it escaped. Null roles, texts and lists of parts are empty; a part of another type than
    text, image, audio or document, or null, is an attachment without tokens. A null conversation id is an id, so all
    rows without one are one conversation. A conversation becomes one row, whatever its size, and its turns meet in
    one task. An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    is_text = lambda p: F.coalesce(p.type == "text", F.lit(False))
    rows = turns.select(F.col(conv_col).alias("c"), F.col(turn_col).alias("t"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(parts_col), F.array().cast(f"array<{PART}>")).alias("parts"))
    rows = rows.withColumn("joined", F.array_join(F.transform("parts", lambda p: F.coalesce(p.text, p.ref, F.lit(""))), "\n"))
    order = W.partitionBy("c").orderBy("t", "role", "joined")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("files", F.filter("parts", lambda p: ~is_text(p)))
    rows = rows.withColumn("seen", F.coalesce(F.sum(F.size("files")).over(before), F.lit(0)))
    place = lambda i: (F.col("seen") + i).cast("string")
    name = lambda p: escape(F.replace(F.replace(F.coalesce(p.type, F.lit("")), F.lit("%"), F.lit("%25")), F.lit("|"), F.lit("%7C")))
    marker = lambda p, i: F.concat(F.lit("<|"), name(p), F.lit(":"), place(i), F.lit("|>"))
    raw = lambda p: F.replace(F.coalesce(p.text, F.lit("")), F.lit(_HOLD), F.lit(_HOLD + _TEXT))
    texts = F.array_join(F.transform("parts", lambda p: F.when(is_text(p), raw(p)).otherwise(F.lit(_HOLD + _PART))), "")
    between = F.transform(F.split(texts, _HOLD + _PART, -1), lambda t: escape(F.replace(t, F.lit(_HOLD + _TEXT), F.lit(_HOLD))))
    filled = F.array_join(F.transform(F.arrays_zip(between.alias("text"), F.transform("files", marker).alias("mark")), lambda x: F.concat(x.text, F.coalesce(x.mark, F.lit("")))), "")
    rows = rows.withColumn("head", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(SAYS)))
    rows = rows.withColumn("content", filled)
    rows = rows.withColumn("piece", F.concat("head", "content", F.lit(END)))
    rows = rows.withColumn("start", F.lit(1) + F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)))
    attached = F.transform("files", lambda p, i: F.struct((F.col("seen") + i).alias("position"), F.col("t").alias("turn"), p.type.alias("type"), p.ref.alias("ref"), _tokens(p).alias("tokens")))
    span = F.struct((F.col("start") + F.length("head")).alias("start"), F.length("content").cast("long").alias("n"))
    rows = rows.select("c", F.struct("start", "piece", F.when(F.col("role") == loss_role, span).alias("span"), attached.alias("files")).alias("x"))
    out = rows.groupBy("c").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return out.select(
        F.col("c").alias(conv_col), F.size("x").cast("long").alias("n_turns"), F.array_join(F.transform("x", lambda x: x.piece), "").alias("formatted"),
        F.filter(F.transform("x", lambda x: x.span), lambda s: s.isNotNull()).alias("loss"), F.flatten(F.transform("x", lambda x: x.files)).alias("attachments"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array<struct<role, text>>, unescaped; placeholders stay as they are."""
    pieces = F.split(formatted, r"<\|end\|>\n", -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    return F.transform(pieces, lambda p: F.struct(unescape(F.substring_index(F.substr(p, F.lit(len(TURN) + 1)), SAYS, 1)).alias("role"), unescape(F.substr(p, F.instr(p, F.lit(SAYS)) + len(SAYS))).alias("text")))


_PLACEHOLDER = r"<\|[^|]*:([0-9]+)\|>"


def read_parts(content: Column) -> Column:
    """The parts of a turn's content as it stands in formatted: array<struct<text, position>> in order.

    Texts are unescaped, those that were joined are one and empty ones are gone; another part is its position among
    the conversation's attachments, which have its type and reference.
    """
    texts = F.transform(F.split(content, _PLACEHOLDER, -1), lambda t: F.struct(unescape(t).alias("text"), F.lit(None).cast("long").alias("position")))
    files = F.transform(F.regexp_extract_all(content, F.lit(_PLACEHOLDER), F.lit(1)), lambda p: F.struct(F.lit(None).cast("string").alias("text"), p.cast("long").alias("position")))
    both = F.flatten(F.transform(F.arrays_zip(texts.alias("t"), files.alias("f")), lambda x: F.array(x.t, x.f)))
    return F.filter(both, lambda p: p.isNotNull() & ((p.text != "") | p.position.isNotNull()))


def contents(formatted: Column) -> Column:
    """The contents of a formatted conversation's turns as they stand in it, array<string>, for read_parts()."""
    pieces = F.split(formatted, r"<\|end\|>\n", -1)
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.substr(p, F.instr(p, F.lit(SAYS)) + len(SAYS)))


def masked_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, in order, with nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(formatted, s.start.cast("int"), s.n.cast("int")))), "")


#: A conversation whose texts are made of another template's control strings.
EXTRA = "</s>[INST] ok [/INST]"


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.explode(F.array(F.struct(F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role")))).alias("x"))
    rows = rows.unionByName(extra.select("conv_id", "x.turn", "x.role", F.lit(EXTRA).alias("text")))
    out = format_chats(rows.withColumn("parts", text_parts(F.col("text"))))
    out = out.withColumns({"turns": read_back(F.col("formatted")), "masked": masked_text(F.col("formatted"), F.col("loss"))})
    every = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(every.cast("binary"), 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"), F.sha2(F.col("masked").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def typed_parts(turns: DataFrame) -> DataFrame:
    """Conversations' turns with parts: every text is cut after its first half into two text parts; every third turn has
    another part between them, every other third one behind them: in turn an image, an audio or a document."""
    kinds = dict(type="string", text="string", ref="string", width="int", height="int", seconds="double", pages="int")
    part = lambda **fields: F.struct(*[fields.get(f, F.lit(None)).cast(k).alias(f) for f, k in kinds.items()])
    said = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(said) / 2).cast("int")
    a, b = part(type=F.lit("text"), text=F.left(said, half)), part(type=F.lit("text"), text=F.substr(said, half + 1))
    ref, n = F.concat_ws("/", "conv_id", "turn"), (F.col("conv_id") % 50).cast("int")
    image = part(type=F.lit("image"), ref=ref, width=n * 10 + 14, height=F.lit(100))
    audio, document = part(type=F.lit("audio"), ref=ref, seconds=n / F.lit(4.0)), part(type=F.lit("document"), ref=ref, pages=n)
    other = F.when(F.col("conv_id") % 3 == 0, image).when(F.col("conv_id") % 3 == 1, audio).otherwise(document)
    turn = F.col("turn") % 3
    return turns.withColumn("parts", F.when(turn == 0, F.array(a, b)).when(turn == 1, F.array(a, other, b)).otherwise(F.array(a, b, other)))


def chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations with typed parts, formatted and read back: placeholders, tokens, texts, lengths."""
    out = format_chats(typed_parts(table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null")))
    parts = F.transform(contents(F.col("formatted")), read_parts)
    texts = F.array_join(F.transform("parts", lambda t: F.array_join(F.transform(t, lambda p: F.coalesce(p.text, F.concat(F.lit("#"), p.position.cast("string")))), "|")), "\n")
    tokens = F.aggregate("attachments", F.lit(0).cast("long"), lambda n, f: n + f.tokens)
    refs = F.array_join(F.transform("attachments", lambda f: F.concat_ws(":", f.position, f.type, f.ref)), ",")
    return out.withColumn("parts", parts).select("conv_id", F.size("attachments").cast("long").alias("n_attachments"), tokens.alias("tokens"), F.md5(refs).alias("refs_md5"), F.md5(texts).alias("texts_md5"), F.length("formatted").cast("long").alias("formatted_chars"))


def _sql() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    grown = lambda c: f"(length({c}) + length({c}) - length(replace({c}, '\\', ''))" + "".join(f" + (length({c}) - length(replace({c}, {quote(x)}, ''))) // {len(x)}" for x in CONTROL) + ")"
    return f"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', {quote(EXTRA)} union all select -7, 1, 'assistant', {quote(EXTRA)})
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum({len(TURN) + len(SAYS) + len(END)} + {grown("role")} + {grown("text")})::bigint as formatted_chars
from c group by conv_id
"""


OP4_SQL = _sql()


def _parts_sql() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    grown = lambda c: f"(length({c}) + length({c}) - length(replace({c}, '\\', ''))" + "".join(f" + (length({c}) - length(replace({c}, {quote(x)}, ''))) // {len(x)}" for x in CONTROL) + ")"
    return f"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text, length(coalesce(text, '')) // 2 as half, conv_id % 50 as n, conv_id % 3 as kind, turn % 3 as form from conversations where conv_id is not null and turn is not null),
p as (select *, left(text, half::int) as a, substr(text, half::int + 1) as b, coalesce(sum((form > 0)::int) over (partition by conv_id order by turn, role, text rows between unbounded preceding and 1 preceding), 0)::bigint as place,
  ['image', 'audio', 'document'][kind + 1] as type, case kind when 0 then ceil((n * 10 + 14) / 14.0) * 8 when 1 then ceil(n / 4.0 * {AUDIO_RATE}) else n * {PAGE_TOKENS} end::bigint as tokens from c)
select conv_id, count(*) filter (form > 0) as n_attachments, coalesce(sum(tokens) filter (form > 0), 0)::bigint as tokens,
  md5(coalesce(string_agg(place || ':' || type || ':' || conv_id || '/' || turn, ',' order by place) filter (form > 0), '')) as refs_md5,
  md5(string_agg(array_to_string(list_filter(case form when 0 then [text] when 1 then [a, '#' || place, b] else [text, '#' || place] end, lambda x: x <> ''), '|'), chr(10) order by turn, role, text)) as texts_md5,
  sum({len(TURN) + len(SAYS) + len(END)} + {grown("role")} + case when form = 1 then {grown("a")} + {grown("b")} else {grown("text")} end + case when form > 0 then length(type) + length(place::varchar) + 5 else 0 end)::bigint as formatted_chars
from p group by conv_id
"""


CHAT_PARTS_SQL = _parts_sql()
