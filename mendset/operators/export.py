"""Chat records, prompts and repair-log reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mendset.functions.text import fill, strip

# Message and prompt wording.
SYSTEM_PROMPT = (
    "You are an Infrastructure-as-Code repair assistant. Fix the broken configuration below. "
    "Return ONLY the corrected configuration with no explanation."
)
REPAIR_PROMPT = (
    "This IaC configuration has validation errors:\n\nErrors:\n%s\n\nBroken config:\n```\n%s\n```\n\n"
    "Return the fixed configuration:"
)
DISCUSS_PROMPT = (
    "Analyze this IaC configuration:\n\nValidation errors:\n%s\n\nConfiguration:\n```\n%s\n```\n\n"
    "Explain what's wrong and how to fix it:"
)
INJECT_PROMPT = (
    "Format: %s\nFault category: %s\n\nIntroduce a single %s fault into this config. Make it realistic "
    "— something that would cause validation to fail but isn't immediately obvious.\n\n"
    "Original config:\n```\n%s\n```\n\nReturn the modified config with the fault injected:"
)


def _bullets(title: str, items: Column) -> Column:
    lines = F.transform(items, lambda e: F.concat(F.lit("- "), e))
    return F.when(F.size(items) > 0, F.concat(F.lit(f"{title}:\n"), F.array_join(lines, "\n")))


def chat_record(errors: Column, warnings: Column, fmt: Column, broken: Column, gold: Column) -> Column:
    """array<struct<role,content>>: system, user, assistant."""
    none = F.array().cast("array<string>")
    kind = F.coalesce(fmt, F.lit("terraform"))
    fence = F.when(kind.isin("terraform", "opentofu"), "hcl").otherwise("yaml")
    user = F.concat_ws(
        "\n\n",
        _bullets("Errors", F.coalesce(errors, none)),
        _bullets("Warnings", F.coalesce(warnings, none)),
        fill("Broken config:\n```%s\n%s\n```", fence, broken),
    )
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(message("system", F.lit(SYSTEM_PROMPT)), message("user", user), message("assistant", gold))


def chat_split(split: Column) -> Column:
    return F.when(split == "val", "valid").otherwise(split)


def _joined(items: Column, default: str) -> Column:
    return F.when(F.size(F.coalesce(items, F.array().cast("array<string>"))) > 0, F.array_join(items, "\n")).otherwise(default)


def repair_prompt(config: Column, errors: Column) -> Column:
    return fill(REPAIR_PROMPT, _joined(errors, "Unknown error"), config)


def discuss_prompt(config: Column, errors: Column, warnings: Column) -> Column:
    return fill(DISCUSS_PROMPT, _joined(F.concat(errors, warnings), "No validation errors"), config)


def needs_discussion(valid: Column, warnings: Column) -> Column:
    return ~(valid & (F.size(warnings) == 0))


def inject_prompt(config: Column, category: Column, fmt: Column) -> Column:
    return fill(INJECT_PROMPT, fmt, category, F.lower(category), config)


def repair_outcome(valid: Column, original: Column, repaired: Column, verified: Column) -> Column:
    """PASS, NO_CHANGE, FIXED or UNVERIFIED; a missing verdict of the repair is not a pass."""
    same = (F.coalesce(F.length(repaired), F.lit(0)) == 0) | (strip(repaired) == strip(original))
    return (
        F.when(valid, "PASS")
        .when(same, "NO_CHANGE")
        .when(F.coalesce(verified, F.lit(False)), "FIXED")
        .otherwise("UNVERIFIED")
    )


def repair_summary(config: Column, errors: Column, repaired: Column, verdict_valid: Column, verdict_errors: Column) -> Column:
    """struct(repaired, original_errors, verified, remaining_errors); without errors, pass-through."""
    n = F.coalesce(F.size(errors), F.lit(0))
    row = lambda text, verified, left: F.struct(
        text.alias("repaired"), n.alias("original_errors"), verified.alias("verified"), left.alias("remaining_errors")
    )
    clean = row(config, F.lit(True), F.lit(0))
    left = F.when(verdict_errors.isNotNull(), F.size(verdict_errors)).otherwise(-1)
    return F.when(n <= 0, clean).otherwise(row(repaired, F.coalesce(verdict_valid, F.lit(False)), left))


