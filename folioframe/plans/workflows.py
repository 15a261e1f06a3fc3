"""Workflows: analyse, correct, execute.  Each step is a set of lazy DataFrames over the same inputs."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import merge, trees
from ..sources import sinks


class StrictError(RuntimeError):
    """Strict mode found pages without a place."""


class MissingInput(FileNotFoundError):
    """An input is not there."""


@dataclass(frozen=True)
class Result:
    inventory: DataFrame
    issues: DataFrame
    summary: DataFrame
    plan: DataFrame


class MergeWorkflow:
    """Merges addenda into an original: pages ``doc, set_id, source, page_index, id, confidence_pct``."""

    def __init__(self, pages: DataFrame, mode: str = "replace+insert", strict: bool = False, strict_compat: bool = False) -> None:
        self.pages, self.mode, self.strict, self.strict_compat = pages, mode, strict, strict_compat

    def analyze(self) -> Result:
        inventory = merge.inventory_rows(merge.cover_pages(self.pages))
        plan = merge.plan_merge(inventory.select("set_id", "source", "page_index", "id"), self.mode, self.strict_compat)
        lost = plan.where("pos < 0").select(F.concat(F.lit("set-"), F.col("set_id").cast("string")).alias("doc"), "page_index", F.col("status").alias("reason"))
        return Result(inventory, merge.unmatched_issues(lost), merge.summary(inventory), plan)

    def apply_corrections(self, result: Result, overlay: DataFrame) -> Result:
        """Corrections ``uid, ignored, new_id``; the plan is made again from the corrected inventory, and no page is read twice."""
        inventory = merge.apply_corrections(result.inventory, overlay)
        plan = merge.plan_merge(inventory.select("set_id", "source", "page_index", "id"), self.mode, self.strict_compat)
        return replace(result, inventory=inventory, summary=merge.summary(inventory), plan=plan)

    def execute(self, result: Result, path: str | None = None) -> DataFrame:
        """The runs of pages to copy, written as JSON if a path is given."""
        if self.strict and not result.plan.where("pos < 0").isEmpty():
            raise StrictError("pages without a place; see the issues")
        copies = sinks.page_copy_plan(result.plan)
        if path:
            sinks.write_json(copies, path)
        return copies


class OutlineWorkflow:
    """Shapes, corrects and validates an outline ``node_id, parent_id, level, ord, title, page_index``."""

    def __init__(self, nodes: DataFrame, page_count: int, max_depth: int = 3) -> None:
        self.nodes, self.page_count, self.max_depth = nodes, page_count, max_depth

    def analyze(self) -> DataFrame:
        return trees.validate_destinations(trees.dedupe_siblings(trees.shape_outline(self.nodes, self.max_depth)), self.page_count)

    def apply_corrections(self, nodes: DataFrame, changes: DataFrame) -> DataFrame:
        return trees.validate_destinations(trees.correct_outline(nodes.drop("is_valid", "error"), changes), self.page_count)

    def execute(self, nodes: DataFrame, allow_invalid: bool = False) -> DataFrame:
        """Links as they are written."""
        if not allow_invalid and not nodes.where("NOT is_valid").isEmpty():
            raise StrictError("destinations that don't exist")
        return trees.sibling_links(nodes)
