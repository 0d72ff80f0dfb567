"""Three ways to tell the format of a file. They differ on purpose; all are kept."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mendset.functions.text import strip


def suffix(path: Column) -> Column:
    """Last extension of the file name with its dot; '' for none and for dot files."""
    return F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)


def format_by_suffix(path: Column) -> Column:
    s = F.lower(suffix(path))
    return F.when(s.isin(".yaml", ".yml", ".json", ".template"), "cloudformation").otherwise("terraform")


def looks_like_template(text: Column) -> Column:
    """A top-level version or Resources key, in YAML by its line, in JSON by its keys."""
    yaml = text.rlike("(?m)^[\"']?(AWSTemplateFormatVersion|Resources)[\"']?[ \\t]*:")
    keys = F.when(strip(text).startswith("{"), F.json_object_keys(text))
    json = F.arrays_overlap(keys, F.array(F.lit("AWSTemplateFormatVersion"), F.lit("Resources")))
    return yaml | F.coalesce(json, F.lit(False))


def format_by_path_content(path: Column, text: Column) -> Column:
    s = suffix(path)
    return (
        F.when(s == ".tf", "terraform")
        .when(F.lower(path).contains("cloudformation"), "cloudformation")
        .when(s.isin(".yaml", ".yml", ".json", ".template") & looks_like_template(text), "cloudformation")
        .otherwise("terraform")
    )


def format_with_confidence(path: Column, text: Column) -> Column:
    s = F.lower(suffix(path))
    versioned = text.contains("AWSTemplateFormatVersion")
    typed = text.contains("Type: AWS::") | text.contains('"Type": "AWS::')
    blocks = text.contains("resource ") & text.contains("{") & text.contains("provider ")

    def answer(fmt: str, confidence: float) -> Column:
        return F.struct(F.lit(fmt).alias("format"), F.lit(confidence).alias("confidence"))

    return (
        F.when(s == ".tf", answer("terraform", 1.0))
        .when(s.isin(".yaml", ".yml", ".json") & versioned, answer("cloudformation", 1.0))
        .when(s.isin(".yaml", ".yml", ".json") & typed, answer("cloudformation", 0.9))
        .when(s == ".hcl", answer("terraform", 0.8))
        .when(blocks, answer("terraform", 0.6))
        .when(versioned, answer("cloudformation", 0.9))
        .otherwise(answer("terraform", 0.3))
    )
