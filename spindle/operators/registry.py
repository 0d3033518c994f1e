"""Registries of documents with front matter, and the graph of a notebook's cells."""

from __future__ import annotations

import ast

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .relational import dedupe_keep, union_tagged


def load(files: DataFrame, fields: tuple = ("description", "category", "cost", "parent_skill")) -> DataFrame:
    """A row for each name in the front matter of ``(path, value)``; the last path of a name counts, files without one go."""
    rows = files.select("path", tx.front_field(F.col("value"), "name").alias("name"), *[tx.front_field(F.col("value"), f).alias(f) for f in fields])
    return dedupe_keep(rows.filter("name is not null"), "name", "path", "last")


def shallow(files: DataFrame, depth: int = 3) -> DataFrame:
    """Files at most ``depth`` folders below the root of their path."""
    return files.filter(F.size(F.split(F.ltrim(F.col("path"), F.lit("/")), "/")) - 1 <= depth)


def resolve(personal: DataFrame, base: DataFrame, prefer: str = "personal") -> DataFrame:
    """Each name once: its personal entry if there is one; ``prefer="base"`` forces the other."""
    both = union_tagged({"personal": personal, "base": base}, "origin")
    return dedupe_keep(both.withColumn("_first", (F.col("origin") == prefer).cast("int")), "name", "_first", "last").drop("_first")


#: Costs from low to high: fixed values.
COSTS = ("FREE", "CHEAP", "EXPENSIVE")


def lookup(skills: DataFrame, *, name: str | None = None, category: str | None = None, cost: str | None = None, parent: str | None = None) -> DataFrame:
    """The skills of a name, a category, a cost or a parent, or of several at once; all without any."""
    wanted = {"name": name, "category": category, "cost": cost, "parent_skill": parent}
    for column, value in wanted.items():
        skills = skills.filter(F.col(column) == value) if value is not None else skills
    return skills


def cost_rank(cost: str = "cost") -> Column:
    return F.array_position(F.array(*map(F.lit, COSTS)), F.upper(cost))


def catalogue_rows(skills: DataFrame) -> DataFrame:
    """Markdown table rows, by the rank of their cost and then by name."""
    row = tx.markdown_row(F.col("name"), F.col("description"), F.col("cost"))
    return skills.select("name", cost_rank().alias("rank"), row.alias("row")).orderBy("rank", "name")


def _called(name: str = "name") -> Column:
    return F.concat(F.lit("`/"), F.col(name), F.lit("`"))


def trigger_rows(skills: DataFrame) -> DataFrame:
    """Rows of the trigger table, by the text of the cost: domain, skill and trigger words (``triggers``: domain, trigger).

    Skills without triggers have no row.
    """
    some = skills.filter(F.size(F.coalesce("triggers", F.array())) > 0)
    words = F.array_join(F.transform("triggers", lambda t: t["trigger"]), ", ")
    return some.select("name", F.col("cost").alias("rank"), tx.markdown_row(F.col("triggers")[0]["domain"], _called(), words).alias("row")).orderBy("rank", "name")


def cost_rows(skills: DataFrame) -> DataFrame:
    """Rows of the cost table, by the rank of the cost: skill, cost and the first of ``use_when``."""
    use = F.coalesce(F.try_element_at("use_when", F.lit(1)), F.lit("General use"))
    return skills.select("name", cost_rank().alias("rank"), tx.markdown_row(_called(), F.col("cost"), use).alias("row")).orderBy("rank", "name")


def delegation_rows(skills: DataFrame) -> DataFrame:
    """Rows of the delegation table: domain, skill, the first of ``use_when`` and of ``avoid_when``."""
    first = lambda c: F.coalesce(F.try_element_at(c, F.lit(1)), F.lit("N/A"))
    some = skills.filter(F.size(F.coalesce("triggers", F.array())) > 0)
    return some.select("name", tx.markdown_row(F.col("triggers")[0]["domain"], _called(), first("use_when"), first("avoid_when")).alias("row"))


def cell_map(notebooks: DataFrame) -> DataFrame:
    """``(path, name, line, inputs, outputs)`` of each cell function in reactive notebooks ``(path, value)``.

    Cells are told apart by name and line, since many are all named ``_``.
    """
    import pandas as pd

    def run(batches):
        for rows in batches:
            out = []
            for path, source in zip(rows.path, rows.value):
                try:
                    tree = ast.parse(source)
                except SyntaxError:
                    continue
                for node in tree.body:
                    if isinstance(node, ast.FunctionDef):
                        back = next((s.value for s in node.body[::-1] if isinstance(s, ast.Return)), None)
                        names = [e.id for e in getattr(back, "elts", [back] if back else []) if isinstance(e, ast.Name)]
                        out.append((path, node.name, node.lineno, [a.arg for a in node.args.args], names))
            yield pd.DataFrame(out, columns=["path", "name", "line", "inputs", "outputs"])

    return notebooks.select("path", "value").mapInPandas(run, "path string, name string, line long, inputs array<string>, outputs array<string>")


def graph_faults(cells: DataFrame) -> DataFrame:
    """``(path, fault, variable)``: variables with several definitions, and inputs that nothing defines."""
    made = cells.select("path", F.explode("outputs").alias("variable"))
    used = cells.select("path", F.explode("inputs").alias("variable")).distinct()
    several = made.groupBy("path", "variable").count().filter("count > 1").select("path", F.lit("several definitions").alias("fault"), "variable")
    loose = used.join(made, ["path", "variable"], "left_anti").select("path", F.lit("no definition").alias("fault"), "variable")
    return several.unionByName(loose)


def edges(cells: DataFrame) -> DataFrame:
    """``(path, source, target)``: lines of the cells that define and use a variable."""
    made = cells.select("path", F.col("line").alias("source"), F.explode("outputs").alias("variable"))
    used = cells.select("path", F.col("line").alias("target"), F.explode("inputs").alias("variable"))
    return made.join(used, ["path", "variable"]).select("path", "source", "target").distinct()


def has_cycle(edge_rows: list[tuple]) -> bool:
    """Whether a notebook's edges (a small list) form a cycle."""
    from graphlib import CycleError, TopologicalSorter

    graph: dict = {}
    for source, target in edge_rows:
        graph.setdefault(target, set()).add(source)
    try:
        tuple(TopologicalSorter(graph).static_order())
    except CycleError:
        return True
    return False


def behind(status: Column) -> Column:
    """Whether the branch line of a porcelain status text says that the branch is behind; no text is no."""
    lines = F.split(F.coalesce(status, F.lit("")), "\n")
    return F.exists(lines, lambda x: x.startswith("## ") & x.contains("[behind "))


def settings(rows: DataFrame, names: list[str], name: str = "name", value: str = "value") -> DataFrame:
    """Of the named settings those that have a value, masked; ``(name, shown)``."""
    some = rows.filter(F.col(name).isin(*names) & (F.coalesce(F.col(value), F.lit("")) != ""))
    return some.select(F.col(name).alias("name"), tx.mask_secret(F.col(value)).alias("shown"))


def tallied(outcomes: DataFrame, ok: Column) -> DataFrame:
    """One row: how many items went well, how many failed, and all."""
    good = F.count_if(F.coalesce(ok, F.lit(False)))
    return outcomes.agg(good.alias("succeeded"), (F.count("*") - good).alias("failed"), F.count("*").alias("total"))
