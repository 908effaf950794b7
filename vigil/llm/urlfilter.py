"""URL filter: explicit rules, then a path-template tree learned per host.

Rules are (host, path) prefixes with a verdict; the longest that fits decides. The rest is
judged by templates. Per host the path segments form a tree; level by level

* a node whose children are many and mostly distinct (at least ``min_children`` and
  ``spread`` children per url) is generalised: all its children become one wildcard, as
  do numbers, long hexadecimal names and segments below ``depth``;
* labelled sibling branches whose bad share does not differ from the siblings' pooled
  share by more than ``z`` standard errors are merged into one branch.

A template is rejected when its smoothed share of bad labels,
(bad + strength / 2) / (labelled + strength), reaches ``reject``; a template without labels
has a half and is allowed. Labels come from the caller; by default the urls that rules decide
are the labelled ones (block is bad).

All of it is column expressions, joins and aggregates over distinct (host, path) pairs.

Edge cases: a null url or one without ``://`` has empty host and path and is allowed unless a
rule or template says otherwise; repeated rows each get their verdict and count each in
the statistics; a null id is returned as it is; an empty table gives no rows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import materialize

NUMBER, HEX = r"^[0-9]+(\.[a-z0-9]{1,5})?$", r"^[0-9a-fA-F-]{16,}$"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_name(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule (verdict, host, path) that fits; a short list, tested in order of length."""
    chosen = F.lit(None).cast("string")
    for _, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):  # the longest is tested first
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        chosen = F.when(fits, F.lit(rule_host + rule_path)).otherwise(chosen)
    return chosen


def templates(paths: DataFrame, depth: int = 6, min_children: int = 12, spread: float = 0.2, z: float = 2.0) -> DataFrame:
    """``paths(host, path, n, labelled, bad)`` -> the same with the path's ``template``."""
    parts = F.slice(F.split(F.col("path"), "/"), 2, 1 << 30)
    plain = F.transform(parts, lambda s: F.when(s.rlike(NUMBER) | s.rlike(HEX), F.lit("*")).otherwise(s))
    cut = F.when(F.size(plain) > depth, F.concat(F.slice(plain, 1, depth), F.array(F.lit("**")))).otherwise(plain)
    tree = paths.select("host", "path", "n", "labelled", "bad", cut.alias("parts"), F.lit("").alias("template"))
    levels = tree.agg(F.max(F.size("parts"))).first()[0] or 0  # at most depth + 1
    for level in range(levels):
        tree = materialize(_generalise(tree, F.try_element_at("parts", F.lit(level + 1)), min_children, spread, z), "url-tree")
    return tree.drop("parts")


def _generalise(tree: DataFrame, part: Column, min_children: int, spread: float, z: float) -> DataFrame:
    node = ["host", "template"]
    branches = (tree.withColumn("part", part).where("part is not null").groupBy(*node, "part")
                .agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")))
    nodes = branches.groupBy(*node).agg(F.count("*").alias("children"), F.sum("n").alias("urls"),
                                        F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"))
    pooled = F.col("all_bad") / F.col("all_labelled")
    error = F.sqrt(pooled * (1 - pooled) / F.col("labelled"))
    wild = (F.col("children") >= min_children) & (F.col("children") >= spread * F.col("urls"))
    alike = (F.col("labelled") > 0) & (F.abs(F.col("bad") / F.col("labelled") - pooled) <= z * error)
    name = F.when(wild, F.lit("*")).when(alike & (F.col("children") > 1), F.lit("~")).otherwise(F.col("part"))
    renamed = branches.join(nodes, node).select(*node, "part", name.alias("name"))
    mapped = tree.withColumn("part", part).join(renamed, [*node, "part"], "left")
    return mapped.select("host", "path", "n", "labelled", "bad", "parts",
                         F.when(F.col("name").isNull(), F.col("template"))
                         .otherwise(F.concat("template", F.lit("/"), "name")).alias("template"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url: str = "url",
          label: Column | None = None, strength: float = 2.0, reject: float = 0.75, **tree) -> DataFrame:
    """Per page: id, host, path, the rule that fits (else null) and the verdict. ``label``
    is a boolean column (true: bad) of ``pages``; by default the rules' verdicts."""
    rows = pages.select(F.col(id_col).alias("id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"),
                        (F.lit(None).cast("boolean") if label is None else label).alias("label"))
    rows = rows.withColumn("rule", rule_name(F.col("host"), F.col("path"), rules))
    said = F.lit(None).cast("string")
    for verdict in ("allow", "block"):
        names = [h + p for v, h, p in rules if v == verdict]
        said = F.when(F.col("rule").isin(names), F.lit(verdict)).otherwise(said) if names else said
    rows = rows.withColumn("said", said)
    if label is None:
        rows = rows.withColumn("label", F.col("said") == "block")
    paths = rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("label").alias("labelled"), F.count_if("label").alias("bad"))
    tree_rows = templates(materialize(paths, "url-paths"), **tree)
    purity = tree_rows.groupBy("host", "template").agg(
        ((F.sum("bad") + strength / 2) / (F.sum("labelled") + strength)).alias("purity"))
    rejected = purity.where(F.col("purity") >= reject).select("host", "template")
    bad_paths = materialize(tree_rows.join(rejected, ["host", "template"], "left_semi").select("host", "path"), "rejected-paths")
    judged = rows.join(bad_paths.withColumn("rejected", F.lit(True)), ["host", "path"], "left")
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule",
                         F.coalesce("said", F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))
