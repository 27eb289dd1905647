"""Prompts put together under a token budget."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V


def estimated_tokens(text: Column) -> Column:
    """A quarter of the ASCII characters and 1/1.7 of all others, whole part, at least 1."""
    t = F.coalesce(text, F.lit(""))
    ascii_ = F.length(F.regexp_replace(t, r"[^\x{0}-\x{7f}]", ""))
    return F.greatest(F.lit(1), (ascii_ / 4.0 + (F.length(t) - ascii_) / 1.7).cast("int"))


def parsed_skills(names: str, default: tuple[str, ...] = ("scientific-learning",)) -> list[str]:
    """Skills asked for by name or alias, separated by commas, each once and in order; ``all`` and ``default`` stand for several."""
    out: list[str] = []
    for n in (x.strip().lower() for x in names.split(",")):
        for s in sorted(V.SKILLS) if n == "all" else list(default) if n in ("", "default") else [V.SKILL_ALIASES.get(n, n)]:
            if s not in V.SKILLS:
                raise ValueError(f"unknown skill: {s}")
            if s not in out:
                out.append(s)
    return out


def fit(items: DataFrame, budget: int) -> DataFrame:
    """``grp, ord, tokens, kept, used``: items of each group in order, kept if they still fit; later smaller ones may still enter.

    ``items``: ``grp`` string, ``ord`` bigint, ``tokens`` int. Groups are spread by hash and sorted within partitions, where the
    sort spills; the fold streams over the rows and holds one number, so a group of any size fits.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, used = None, 0
        for batch in batches:
            kept, upto = [], []
            for g, t in zip(batch["grp"].tolist(), batch["tokens"].tolist()):
                if g != group:
                    group, used = g, 0
                fits = used + t <= budget
                used += t if fits else 0
                kept.append(fits)
                upto.append(used)
            yield batch.assign(kept=kept, used=upto)

    rows = items.dropna(subset=["grp", "ord"]).select("grp", "ord", F.coalesce("tokens", F.lit(1)).cast("int").alias("tokens"))
    ordered = rows.repartition("grp").sortWithinPartitions("grp", "ord")
    return ordered.mapInPandas(fold, "grp string, ord bigint, tokens int, kept boolean, used bigint")


def fitting(items: DataFrame, budget: int, keep: Callable[[DataFrame, str], DataFrame], at_once: int = 4096) -> DataFrame:
    """``grp, ord, tokens, used``: the items that ``fit`` keeps, without any group in one task.

    In each round only items that still fit come into question, and of these the first ``at_once`` of each group, which a limited
    window finds task by task before its shuffle. They are folded; then comes what lies behind them and fits what is left. The
    first item of a round always fits, so rounds end, and a group takes part only until nothing more fits.
    """

    def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        left, kept, used = int(rows["left"].iloc[0]), [], []
        rows = rows.sort_values(["ord", "tokens"])
        for t in rows["tokens"].tolist():
            fits = t <= left
            left -= t if fits else 0
            kept.append(fits)
            used.append(budget - left)
        return rows.assign(kept=kept, used=used)[["grp", "ord", "tokens", "kept", "used"]]

    rows = items.dropna(subset=["grp", "ord"]).select("grp", "ord", F.coalesce("tokens", F.lit(1)).cast("int").alias("tokens"))
    state = None
    out = rows.limit(0).withColumn("used", F.lit(None).cast("bigint"))
    order = Window.partitionBy("grp").orderBy("ord", "tokens")
    while True:
        if state is None:
            open_ = rows.where(F.col("tokens") <= budget).withColumn("left", F.lit(budget).cast("bigint"))
        else:
            open_ = rows.join(state, "grp").where((F.col("ord") > F.col("last")) & (F.col("tokens") <= F.col("left"))).drop("last")
        first = open_.withColumn("r", F.row_number().over(order)).where(F.col("r") <= at_once).drop("r")
        done = keep(first.groupBy("grp").applyInPandas(fold, "grp string, ord bigint, tokens int, kept boolean, used bigint"), "round")
        if done.isEmpty():
            return out
        out = out.unionByName(done.where("kept").drop("kept"))
        state = done.groupBy("grp").agg((F.lit(budget) - F.max("used")).cast("bigint").alias("left"), F.max("ord").alias("last"))


@dataclass(frozen=True)
class Target:
    """A form that a prompt is made for: how it is called, the file it goes to, and whether it can read local files."""

    name: str
    label: str
    file: str
    files: bool = True


#: Forms by name; others are given by the caller.
TARGETS = {"generic": Target("generic", "Generic Agent", "agent-system-prompt.md")}


def target(name: str, targets: dict[str, Target] | None = None) -> Target:
    """The form of that name, whatever its case and outer blanks; an unknown one raises."""
    known = TARGETS if targets is None else targets
    found = known.get(name.strip().lower())
    if found is None:
        raise ValueError(f"unknown target {name!r}; known: {', '.join(sorted(known))}")
    return found


def header(form: Target) -> str:
    note = "Use local files as memory where there are any." if form.files else "There is no local memory; what is to be remembered must be given."
    return f"# Compiled prompt\n\nTarget: {form.label}\n\n- Load this as the system instruction.\n- Keep the sections apart.\n- {note}\n"


def _text_tokens(text: str) -> int:
    plain = sum(c < "\x80" for c in text)
    return max(1, int(plain / 4 + (len(text) - plain) / 1.7))


RULE = "\n\n---\n\n"


def assemble(form: Target, rules: str, skills: list[tuple[str, str]], memory: str = "", budget: int | None = None) -> tuple[str, list[str], bool]:
    """Prompt text, kept skills, and whether anything was left out.

    Header and rules always stay. If the whole doesn't fit, skills come in order, each if the whole candidate with it and the
    memory section still fits by its estimate; the memory comes last and if the whole with it fits.
    """

    def put(parts: list[str]) -> str:
        return "".join(parts).strip() + "\n"

    first = [header(form), RULE + "# Global Rules\n\n", rules.strip()]
    sections = [(n, f"{RULE}# Skill: {n}\n\n{b.strip()}\n") for n, b in skills]
    last = [f"{RULE}# Memory Strategy\n\n{memory.strip()}\n"] if memory else []
    whole = put([*first, *(b for _, b in sections), *last])
    if not budget or _text_tokens(whole) <= budget:
        return whole, [n for n, _ in skills], False
    parts, kept = list(first), []
    for n, b in sections:
        if _text_tokens(put([*parts, b, *last])) <= budget:
            parts.append(b)
            kept.append(n)
    short = len(kept) < len(skills)
    if last:
        if _text_tokens(put(parts + last)) <= budget:
            parts += last
        else:
            short = True
    return put(parts), kept, short
