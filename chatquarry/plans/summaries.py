"""Texts of reports, from rows that a query has already reduced to a few."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timezone


def line(name: str, report: Mapping) -> str:
    """`name: n_problems=.. n_completions=.. pass_at_1=0.1234 ..`, metrics with four digits."""
    metrics = " ".join(f"{k}={v:.4f}" for k, v in report.items() if isinstance(v, float))
    return f"{name}: n_problems={report['n_problems']} n_completions={report.get('n_completions', 0)} {metrics}".rstrip()


def table(rows: Sequence[Mapping], names: Sequence[str], key: str = "key") -> str:
    """Rows in a fixed order of names, zeros for names without a row."""
    by = {r[key]: r for r in rows}
    out = []
    for n in names:
        r = by.get(n)
        out.append(f"  {n:<24} n={r['n_problems'] if r else 0:>5} pass@1={r['pass_at_1'] if r else 0.0:.3f} pass@n={r['pass_at_n'] if r else 0.0:.3f}")
    return "\n".join(out)


def progress(chunk: int, attempts: int, correct: int, kept: int) -> str:
    rate = correct / attempts if attempts else 0.0
    return f"chunk {chunk}: {attempts} attempts, {correct} correct ({rate:.1%}), {kept} kept"


def run_name(tag: str, now: datetime | None = None) -> str:
    return f"{tag}-{(now or datetime.now(timezone.utc)):%Y%m%d-%H%M%S}"
