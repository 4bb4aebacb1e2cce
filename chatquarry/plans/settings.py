"""Settings that are resolved on the driver before a plan is built."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import SparkSession

from ..sources import sinks

#: Sampling settings where neither the caller nor a file has them, and context caps (fixed values).
FALLBACK = {"temperature": 0.3, "top_p": 0.95, "top_k": 20}
CAPS = {"strict": (4096, 4096), "legacy": (20480, 16384)}
#: Token caps by kind of source (fixed values).
TOKEN_CAPS = {"bucketed": 2900, "generated": 3500, "mixed": 3500, "raw": None}


def warmup_steps(rows: int, batch: int, epochs: float, ratio: float = 0.03) -> int:
    """At least one; halves round to even."""
    return max(1, round(ratio * math.ceil(rows / batch) * epochs))


def settings_file(spark: SparkSession, path: str) -> dict | None:
    """A JSON object, or YAML's where the name ends so; None where the file is absent or isn't one."""
    if not path.endswith((".yaml", ".yml")):
        return sinks.document_at(spark, path)
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("YAML settings need the yaml package") from e
    try:
        found = yaml.safe_load(text_file(spark, path)) if sinks.exists(spark, path) else None
    except yaml.YAMLError:
        return None
    return found if isinstance(found, dict) else None


def sampling(given: Mapping, file: Mapping | None) -> dict:
    """Each setting from the caller, else the file, else the fallback."""
    return {k: given[k] if given.get(k) is not None else (file or {}).get(k, v) for k, v in FALLBACK.items()}


def context_caps(mode: str = "strict", model_len: int | None = None, new_tokens: int | None = None) -> tuple[int, int]:
    """(model length, new tokens): the mode's, each overridden alone."""
    a, b = CAPS[mode]
    return (a if model_len is None else model_len), (b if new_tokens is None else new_tokens)


def check_context(model_len: int, supported: int) -> None:
    if model_len > supported:
        raise ValueError(f"a context of {model_len} is over the supported {supported}")


def token_budget(new_tokens: int, trained_length: int, cap: int) -> list[str]:
    """Advice on a budget of new tokens that goes beyond the scorer's cap or the trained length; none is an error."""
    limits = {"the scorer's cap": cap, "the trained length": trained_length}
    return [f"{new_tokens} new tokens are over {what} of {most}" for what, most in limits.items() if new_tokens > most]


def text_file(spark: SparkSession, path: str) -> str:
    """A template's or a configuration's text."""
    return spark.read.text(path, wholetext=True).first()[0]
