"""Chat messages: building, validating and rendering them. Native columns throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import SPACE, strip
from .boxed import score_answer

START, STOP, THINK = "<|im_start|>", "<|im_end|>", "<think>\n"


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def response(reasoning: Column, answer: Column) -> Column:
    """The canonical response: a think block, then the boxed answer."""
    return F.concat(F.lit("<think>\n"), strip(reasoning), F.lit("\n</think>\n\n\\boxed{"), answer, F.lit("}"))


def example(query: Column, reasoning: Column, answer: Column) -> Column:
    return F.array(message("user", query), message("assistant", response(reasoning, answer)))


def request(system: str, problem: Column) -> Column:
    return F.array(message("system", F.lit(system)), message("user", problem))


def user_then_assistant(messages: Column) -> Column:
    """At least two messages, the first of the user and the second of the assistant."""
    role = lambda k: F.coalesce(F.get(messages, F.lit(k)).role, F.lit(""))
    return F.coalesce(F.size(messages) >= 2, F.lit(False)) & (role(0) == "user") & (role(1) == "assistant")


def prompt_and_gold(messages: Column) -> Column:
    """struct<prompt, gold> of a valid conversation whose answer is boxed; else null."""
    content = lambda k: F.get(messages, F.lit(k)).content
    gold = score_answer(content(1))
    ok = user_then_assistant(messages) & (strip(F.coalesce(content(0), F.lit(""))) != "") & gold.isNotNull()
    return F.when(ok, F.struct(content(0).alias("prompt"), gold.alias("gold")))


def render(messages: Column, generate: bool = False) -> Column:
    """The conversation in the locked template, thinking always on; other roles than three vanish.

    A first system message comes first. An assistant's text is what follows its last </think>, led by what precedes
    its first one if it has <think>; a text with <think> but no </think> therefore comes twice. generate adds the
    opening of an assistant's turn.
    """
    turn = lambda role, body: F.concat(F.lit(START), role, F.lit("\n"), body, F.lit(f"{STOP}\n"))

    def assistant(content: Column) -> Column:
        answer = F.when(F.contains(content, F.lit("</think>")), F.regexp_replace(F.substring_index(content, "</think>", -1), r"\A\n+", "")).otherwise(content)
        thought = F.when(F.contains(content, F.lit("<think>")), F.concat(F.substring_index(content, "</think>", 1), F.lit("</think>\n\n"))).otherwise(F.lit(""))
        return F.concat(thought, answer)

    def one(m: Column) -> Column:
        return F.when(m.role.isin("user", "system"), turn(m.role, m.content)).when(m.role == "assistant", turn(m.role, assistant(m.content))).otherwise(F.lit(""))

    text = F.array_join(F.transform(messages, one), "")
    return F.concat(text, F.lit(f"{START}assistant\n")) if generate else text


def generation_prompt(problem: Column) -> Column:
    """A user's problem, rendered, with the opening of the answer's think block."""
    return F.concat(render(F.array(message("user", problem)), generate=True), F.lit(THINK))


def templated(prompt: Column) -> Column:
    """The prompt holds the template's marker and ends with the opening of a think block."""
    return F.contains(prompt, F.lit(START)) & prompt.endswith(THINK)


def squeeze(text: Column) -> Column:
    return F.regexp_replace(text, rf"[{SPACE}]+", " ")
