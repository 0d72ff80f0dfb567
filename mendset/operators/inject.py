"""Applying faults to configs.

The structure of a document (resource spans or nodes) is found once per document, all requested
edits are built from it in the same row, and only then the row is exploded to one row per edit.
No text is shuffled anywhere on the way from a config to its broken variants.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendset.functions.text import is_blank, let, splice
from mendset.operators import faults_hcl, faults_template  # noqa: F401  (they fill the registry)
from mendset.operators.edits import EDIT_TYPE, PLAIN, READS, REGISTRY, SEES, Document, with_measures
from mendset.operators.structure_hcl import resource_spans
from mendset.operators.structure_template import with_nodes
from mendset.operators.taxonomy import FAULTS, HCL_FORMATS

HCL_FAULTS = [f"{f[0]}.{f[1]}" for f in FAULTS if f[3] == HCL_FORMATS]
TEMPLATE_FAULTS = [f"{f[0]}.{f[1]}" for f in FAULTS if f[3] != HCL_FORMATS]


def _typed(fault_id: Column, e: Column) -> Column:
    """What a builder made, as an edit of the fault."""
    fields = ["parts", "original_snippet", "modified_snippet", "location", "description"]
    return F.struct(fault_id.alias("fault_id"), *[e[f] for f in fields]).cast(EDIT_TYPE)


def _edit_column(fault_id: str, document: Document) -> Column:
    return let(REGISTRY[fault_id](document), lambda e: F.when(e.isNotNull(), _typed(F.lit(fault_id), e)))


EDIT_FIELDS = [
    "fault_id", "parts", "original_snippet", "modified_snippet", "location", "description", "broken",
]


def _applied(e: Column) -> Column:
    """The edit with the broken text it makes."""
    broken = splice(F.col("text"), e["parts"], F.col(PLAIN))
    return F.struct(*[e[f] for f in EDIT_FIELDS[:-1]], broken.alias("broken"))


def prepare(configs: DataFrame, family: str, reads: list[tuple] | None = None) -> DataFrame:
    """Add the structure column the builders of a family ("hcl" or "template") read; `reads` as with_nodes takes it."""
    if family == "hcl":
        return configs.withColumn("resource_spans", resource_spans(F.col("text")))
    return with_nodes(configs, reads)


GROUP = 8  # builders that are few enough to stay in a core's cache while rows pass


def _groups(faults: list[str]) -> list[list[str]]:
    """Faults of brace texts, apart by what they see where they are many: their scans are of one group each."""
    if len(faults) <= GROUP:
        return [faults]
    groups: dict[str, list[str]] = {}
    for f in faults:
        groups.setdefault(SEES.get(f, "blocks"), []).append(f)
    return [*groups.values()]


def _reads(faults: list[str]) -> list[tuple] | None:
    """The nodes that any of the faults looks at; None if one looks at all."""
    if not all(f in READS for f in faults):
        return None
    return list(dict.fromkeys(r for f in faults for r in READS[f]))


def edits_of(
    configs: DataFrame,
    family: str,
    faults: list[str] | None = None,
    seed: int = 42,
    salt: str = "",
    variants: int | None = None,
) -> DataFrame:
    """One row per applicable fault of each config, with the broken text.

    A fault without a target yields no row, and so does an edit that changes nothing. With
    `variants`, each config tries only so many of the faults, a run of the list that starts at a
    place drawn for the config, so that a corpus still sees all of them.
    """
    names = faults if faults is not None else (HCL_FAULTS if family == "hcl" else TEMPLATE_FAULTS)
    document = Document(seed, salt)
    columns = [F.col(c) for c in configs.columns]
    made = [REGISTRY[n](document) for n in names]
    if variants is not None:
        first = document.draw("rotation") % len(names)
        made = [F.when((F.lit(i + len(names)) - first) % len(names) < variants, e) for i, e in enumerate(made)]
    staged = with_measures(prepare(configs, family, _reads(names)), family)
    # names, types and texts are given to rows, where the work is compiled; inside an array's function it is interpreted.
    # outer: else the edits are made a second time, in a filter for empty arrays
    rows = staged.select(*columns, F.col(PLAIN), F.posexplode_outer(F.array(*made)).alias("place", "edit"))
    fault = F.get(F.array(*[F.lit(n) for n in names]), F.col("place"))
    found = rows.filter(F.col("edit").isNotNull()).select(*columns, F.col(PLAIN), _typed(fault, F.col("edit")).alias("edit"))
    fields = [F.col(f"edit.{f}") for f in EDIT_FIELDS[:-1]]
    broken = splice(F.col("text"), F.col("edit.parts"), F.col(PLAIN))
    return found.select(*columns, *fields, broken.alias("broken")).filter(F.col("broken") != F.col("text"))


def inject(
    configs: DataFrame,
    hcl_faults: list[str] | None = None,
    template_faults: list[str] | None = None,
    seed: int = 42,
    salt: str = "",
) -> DataFrame:
    """Faults of each config's own format; configs of any other format yield nothing.

    Many faults of brace texts are made in groups, each of which reads the configs.
    """
    hcl = configs.filter(F.col("format").isin(*HCL_FORMATS))
    template = configs.filter(F.col("format") == "cloudformation")
    groups = _groups(HCL_FAULTS if hcl_faults is None else hcl_faults)
    of_hcl = reduce(DataFrame.unionAll, [edits_of(hcl, "hcl", group, seed, salt) for group in groups])
    if template_faults == []:
        return of_hcl
    of_template = edits_of(template, "template", template_faults, seed, salt)
    return of_template if hcl_faults == [] else of_hcl.unionAll(of_template)


def edit_table(injected: DataFrame) -> DataFrame:
    """One row per part of each edit."""
    parts = injected.select(
        "doc_id", "fault_id", F.posexplode("parts").alias("part", "p"),
        "original_snippet", "location", "description",
    )
    return parts.select(
        "doc_id", "fault_id", "part", "p.start", "p.end", "p.replacement",
        "original_snippet", "location", "description",
    )


def trusted_errors(fault_id: Column, example_error: Column) -> Column:
    """What stands in for validator output when a broken text is not validated."""
    error = F.coalesce(F.nullif(example_error, F.lit("")), F.concat(F.lit("Injected "), fault_id))
    return F.array(error)


def break_verdict(
    category: Column, valid: Column, errors: Column, warnings: Column, gold_warnings: Column
) -> Column:
    """Did the edit really break the text? Security faults may show as warnings only."""
    more_warnings = F.size(F.coalesce(warnings, F.array())) > F.size(F.coalesce(gold_warnings, F.array()))
    return ~valid | (F.size(errors) > 0) | ((category == "SECURITY") & more_warnings)


def attempt_loop(
    configs: DataFrame,
    family: str,
    faults: list[str],
    accept: Callable[[Column], Column],
    max_retries: int = 3,
    seed: int = 42,
) -> DataFrame:
    """First accepted attempt per config; attempt i tries fault i mod len(faults) with a new draw.

    `accept` judges an edit (a struct with the edit's fields and `broken`). The attempts of a
    config form one coalesce in its row, so a later one is made only when the earlier ones failed,
    and nothing is shuffled.
    """

    def attempt(i: int) -> Column:
        document = Document(seed, str(i) if i else "")

        def judged(e: Column) -> Column:
            changed = e["broken"] != F.col("text")
            number = F.lit(i + 1).alias("attempts")
            return F.when(changed & accept(e), F.struct(*[e[f] for f in EDIT_FIELDS], number))

        made = let(
            _edit_column(faults[i % len(faults)], document),
            lambda e: F.when(e.isNotNull(), _applied(e)),
        )
        return let(made, judged)

    columns = [F.col(c) for c in configs.columns]
    won = F.coalesce(*[attempt(i) for i in range(max_retries)])
    rows = with_measures(prepare(configs, family, _reads(faults)), family).select(*columns, F.explode(F.filter(F.array(won), lambda e: e.isNotNull())).alias("edit"))
    return rows.select(*columns, *[F.col(f"edit.{f}") for f in [*EDIT_FIELDS, "attempts"]])


def agentic_edits(responses: DataFrame) -> DataFrame:
    """Externally produced broken texts (doc_id, text, category, response), as edit rows."""
    from mendset.operators.gates import passes_gates

    kept = passes_gates(responses.filter(~is_blank(F.col("response"))), "text", "response")
    return kept.select(
        "doc_id",
        F.left("text", F.lit(80)).alias("original_snippet"),
        F.left("broken", F.lit(80)).alias("modified_snippet"),
        F.lit("agentic (full config)").alias("location"),
        F.concat(F.lit("LLM-injected "), F.col("category"), F.lit(" fault")).alias("description"),
        "broken",
    )
