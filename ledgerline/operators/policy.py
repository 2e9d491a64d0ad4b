"""Policies: rules over runs, each answered in three values, and the verdict over all."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.tristate import CANNOT_CHECK, MET, VIOLATED, tally, verdict, worst_of


@dataclass(frozen=True)
class Rule:
    """A named question about a run, as a column of MET, VIOLATED or CANNOT_CHECK."""

    name: str
    asks: str
    answer: Callable[[], Column]


RULES: dict[str, Rule] = {}


def rule(name: str, asks: str) -> Callable[[Callable[[], Column]], Callable[[], Column]]:
    """Register a rule; its function returns the verdict of a row of runs."""

    def add(answer: Callable[[], Column]) -> Callable[[], Column]:
        if name in RULES:
            raise ValueError(f"rule {name} is registered already")
        RULES[name] = Rule(name, asks, answer)
        return answer

    return add


@rule("clean_tree", "was everything committed?")
def _clean_tree() -> Column:
    return verdict(F.col("git_tree_dirty") & F.coalesce("git_status_captured", F.lit(False)), ~F.coalesce("git_status_captured", F.lit(False)))


@rule("commit_recorded", "does the record name a commit?")
def _commit_recorded() -> Column:
    captured = F.coalesce("git_status_captured", F.lit(False))
    return verdict(captured & (F.coalesce("git_commit", F.lit("")) == ""), ~captured)


@rule("no_unregistered_reads", "was every file that was read registered?")
def _no_unregistered_reads() -> Column:
    truncated = F.coalesce("observation.unregistered_watch_truncated", F.lit(0)) > 0
    return verdict(F.col("observation").isNotNull() & (F.coalesce(F.size("unregistered_reads"), F.lit(0)) > 0), F.col("observation").isNull() | truncated)


@rule("outputs_pin_inputs", "do the outputs name what they were made from?")
def _outputs_pin_inputs() -> Column:
    outputs = F.coalesce(F.size("outputs"), F.lit(0)) > 0
    return verdict(outputs & (F.coalesce(F.size("inputs"), F.lit(0)) <= 0), ~outputs)


@rule("environment_captured", "is it known what was installed?")
def _environment_captured() -> Column:
    said = F.col("observation.packages_recorded")
    broken = F.col("environment_snapshot.error").isNotNull() | ((said == "snapshot") & F.col("environment_snapshot.n_packages").isNull())
    return verdict(said == "none", said.isNull() | broken)


@rule("finished_ok", "did the run end well?")
def _finished_ok() -> Column:
    return verdict(F.col("status") != "ok", F.col("status").isNull())


@rule("inputs_verify", "are the inputs still what they were?")
def _inputs_verify() -> Column:
    """What was found when the inputs were looked at again; see :func:`with_inputs`."""
    return F.coalesce(F.col("inputs_verdict"), F.lit(CANNOT_CHECK))


#: For each rule what a verdict rests on, for the reasons of an answer.
REASONS = {
    "clean_tree": ("the tree differs from its commit", "git status was not captured"),
    "commit_recorded": ("no commit is recorded", "git status was not captured"),
    "no_unregistered_reads": ("files were read that are not registered", "reads were not watched, or the watch was cut short"),
    "outputs_pin_inputs": ("outputs without inputs", "no outputs are recorded"),
    "environment_captured": ("packages were not recorded", "it is not known what was recorded"),
    "finished_ok": ("the run failed", "no status is recorded"),
    "inputs_verify": ("an input has changed", "an input can't be compared, or there is none"),
}


def with_inputs(runs: DataFrame, current: DataFrame) -> DataFrame:
    """``runs`` with inputs_verdict, for the rule inputs_verify; ``current``: path, digest, each path once."""
    entries = runs.select("address", F.explode("inputs").alias("e")).select(F.col("address").alias("run"), "e.path", "e.kind", F.coalesce("e.content_sha256", "e.sha256").alias("digest"))
    found = inputs_verify(entries, current).select(F.col("run").alias("__run"), F.col("verdict").alias("inputs_verdict"))
    return runs.join(found, F.col("address") == F.col("__run"), "left").drop("__run")


def reasons(answered: DataFrame) -> DataFrame:
    """(rule, verdict, reason, n) of the verdicts that are not MET."""
    said = F.create_map(*(x for n, why in REASONS.items() for v, w in zip((VIOLATED, CANNOT_CHECK), why, strict=True) for x in (F.lit(f"{n} {v}"), F.lit(w))))
    return answered.filter(F.col("verdict") != MET).groupBy("rule", "verdict").agg(F.count("*").alias("n")).select("rule", "verdict", said[F.concat_ws(" ", "rule", "verdict")].alias("reason"), "n")


def answers(runs: DataFrame, rules: Iterable[str] | None = None, keep: Iterable[str] = ()) -> DataFrame:
    """(keep..., rule, verdict): all rules over all runs in one pass."""
    names = list(rules) if rules is not None else list(RULES)
    unknown = [n for n in names if n not in RULES]
    if unknown or len(set(names)) != len(names) or not names:
        raise ValueError(f"unknown, repeated or no rules: {unknown or names}")
    if "inputs_verify" in names and "inputs_verdict" not in runs.columns:
        runs = runs.withColumn("inputs_verdict", F.lit(CANNOT_CHECK))  # nobody has looked at the inputs
    return unpivoted(runs, {n: RULES[n].answer() for n in names}, keep)


def unpivoted(rows: DataFrame, verdicts: dict[str, Column], keep: Iterable[str] = ()) -> DataFrame:
    """(keep..., rule, verdict) of given verdict columns, in one pass over the rows."""
    pairs = F.array(*(F.struct(F.lit(n).alias("rule"), v.alias("verdict")) for n, v in verdicts.items()))
    return rows.select(*keep, F.explode(pairs).alias("a")).select(*keep, "a.rule", "a.verdict")


def assess(answered: DataFrame, by: list[str]) -> DataFrame:
    """Per group: evaluated, counts of each verdict and the outcome; nothing evaluated can't be checked."""
    v = F.col("verdict")
    return answered.groupBy(*by).agg(F.count("*").alias("evaluated"), *tally(v, MET, VIOLATED, CANNOT_CHECK), worst_of(v, (VIOLATED, CANNOT_CHECK, MET), CANNOT_CHECK).alias("outcome"))


def inputs_verify(inputs: DataFrame, current: DataFrame, run: str = "run") -> DataFrame:
    """(run, verdict) of the rule that all inputs still are what they were.

    ``inputs``: run, path, kind, digest (null where none was taken). ``current``: path, digest
    of what stands there now, each path once. A changed input outranks an unknown one; a
    missing file, a directory and an input without a digest can't be checked.
    """
    now = current.select("path", F.col("digest").alias("now"))
    each = inputs.join(now, "path", "left").select(run, "digest", "now", "kind")
    known = F.col("digest").isNotNull() & F.col("now").isNotNull() & (F.coalesce(F.col("kind"), F.lit("file")) == "file")
    one = each.select(run, verdict(known & (F.col("digest") != F.col("now")), ~known).alias("verdict"))
    return one.groupBy(run).agg(worst_of(F.col("verdict"), (VIOLATED, CANNOT_CHECK, MET), CANNOT_CHECK).alias("verdict"))
