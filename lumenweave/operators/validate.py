"""Row constraints as named predicates, and what to do with rows that break them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid_box(box: Column) -> Column:
    """Four coordinates, none negative."""
    return (F.size(box) == 4) & F.forall(box, lambda v: v >= 0)


def exactly(items: Column, n: int) -> Column:
    return F.size(items) == n


def same_length(a: Column, b: Column) -> Column:
    return F.size(a) == F.size(b)


def two_turns(chat: Column) -> Column:
    """Two turns, one of a human and one of the model."""
    return (F.size(chat) == 2) & F.exists(chat, lambda t: t["role"] == "human") & F.exists(chat, lambda t: t["role"] == "gpt")


def one_of(value: Column, *allowed: str) -> Column:
    return value.isin(*allowed)


def has_payload(task: Column, caption: Column, region: Column, qa_pairs: Column, chat: Column) -> Column:
    """Whether the columns that the task needs are there; a task without a template raises."""
    filled = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    return (
        F.when(task.isin("vqa", "multiple_choice_vqa"), filled(qa_pairs))
        .when(task.isin("captioning", "image_text_match"), caption.isNotNull())
        .when(task.isin("dense_captioning", "visual_grounding"), filled(region))
        .when(task == "chat", filled(chat))
        .when(task == "grounded_multiple_choice_vqa", filled(qa_pairs) & filled(region))
        .when(task == "grounded_captioning", caption.isNotNull() & filled(region))
        .otherwise(F.raise_error(F.concat(F.lit("no template for task "), F.coalesce(task, F.lit("null")))))
    )


def validate(df: DataFrame, rules: dict[str, Column], mode: str = "fail") -> DataFrame:
    """``fail`` stops at a row that breaks a rule; ``skip`` leaves it out; ``flag`` adds ``broken_rules``; ``quarantine`` keeps only rows that break one, with it.

    A rule that is null for a row is broken.
    """
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    flagged = df.withColumn("broken_rules", broken)
    if mode == "flag":
        return flagged
    if mode == "skip":
        return flagged.filter(F.size("broken_rules") == 0).drop("broken_rules")
    if mode == "quarantine":
        return flagged.filter(F.size("broken_rules") > 0)
    if mode != "fail":
        raise ValueError(f"no mode {mode}")
    ok = F.assert_true(F.size("broken_rules") == 0, F.concat(F.lit("broken: "), F.array_join("broken_rules", ", ")))
    return flagged.filter(ok.isNull()).drop("broken_rules")


def same_row_count(a: DataFrame, b: DataFrame) -> None:
    n, m = a.count(), b.count()
    if n != m:
        raise ValueError(f"{n} rows against {m}")
