"""URL filters: a path-template tree per host, whose templates are rejected by the smoothed purity of their labels.

Only DataFrame functions are used. Curated rules decide the urls that they fit, and these decisions are the labels: a
template most of whose labelled urls are blocked also blocks its other urls.
"""

from __future__ import annotations

import math
import string
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revwatch.llm.store import written

#: Chance at which two branches that behave alike are still told apart, for each of three shares.
ALPHA = 0.05
#: Neutral labels that every template starts with, and the purity from which it is rejected.
SMOOTHING = 4.0
REJECT_FROM = 0.8
WILDCARD = "*"
#: Labelled urls that siblings must have before a branch without any is taken as one of them.
ENOUGH = 30
#: Levels that are followed everywhere. Below, only nodes with enough blocked urls to be rejected at all are.
LEVELS = 16


#: The fewest blocked urls with which a template can be rejected.
LEAST_BLOCKED = math.ceil((REJECT_FROM * SMOOTHING - SMOOTHING / 2) / (1 - REJECT_FROM) - 1e-9)


class Rule(NamedTuple):
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str


def parsed(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null and where ``://`` is missing."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3)))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    lowered = F.translate(host, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(lowered, F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, as text and as verdict; both null where none fits."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        text = F.when(fits, rule.host + rule.path).otherwise(text)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def segments(path: Column) -> Column:
    """Segments of a path with variable parts generalised: hexadecimal names as one mark, runs of digits as another."""

    def general(s: Column) -> Column:
        is_hex = F.regexp_like(s, F.lit("^[0-9a-fA-F-]{8,}$")) & F.regexp_like(s, F.lit("[0-9]"))
        return F.when(is_hex, "{hex}").otherwise(F.regexp_replace(s, "[0-9]+", "#"))

    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(parts, general)


def _alike(mine: str, n: str, all_mine: str, all_n: str) -> Column:
    """Whether a share of a branch and that of its siblings differ by no more than chance (Hoeffding's bound)."""
    others = F.nullif(F.col(all_n) - F.col(n), F.lit(0))
    bound = math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / F.sqrt(F.col(n)) + 1 / F.sqrt(others))
    return F.abs(F.col(mine) / F.col(n) - (F.col(all_mine) - F.col(mine)) / others) <= bound


def _labels_alike() -> Column:
    """Whether the labelled urls of a branch and those of its siblings are alike, by their own numbers.

    Shares of blocked ones may differ by chance, but one side may not be mostly blocked while the other is mostly allowed.
    Where only one side has labels, there must be ``ENOUGH`` of them, and the other must be small enough to have none by
    chance at the same share: a few labels say nothing about a branch that has none, and a rule that decides all urls of
    a branch says nothing about the next one.
    """
    mine, others = F.col("bb") + F.col("ba"), F.col("nb") + F.col("na") - F.col("bb") - F.col("ba")
    n, other_n = F.col("bn"), F.col("nn") - F.col("bn")
    share, other_share = F.col("bb") / F.nullif(mine, F.lit(0)), (F.col("nb") - F.col("bb")) / F.nullif(others, F.lit(0))
    bound = math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / F.sqrt(mine) + 1 / F.sqrt(others))
    both = (F.abs(share - other_share) <= bound) & ((share - 0.5) * (other_share - 0.5) >= 0)
    return (
        F.when((mine == 0) & (others == 0), True)
        .when(mine == 0, (others >= ENOUGH) & (F.pow(1 - others / F.nullif(other_n, F.lit(0)), n) >= ALPHA))
        .when(others == 0, (mine >= ENOUGH) & (F.pow(1 - mine / n, other_n) >= ALPHA))
        .otherwise(both)
    )


def template_tree(urls: DataFrame) -> DataFrame:
    """From (host, path, label) rows, label being ``block``, ``allow`` or null, one row per host and generalised path.

    Returns (host, segs, template, urls, blocked, allowed, purity): the last four are those of the whole template. The
    tree is built from the top, over all segments. At every node a branch is compared with its siblings taken together,
    never with each of them: if the shares of blocked among labelled urls and of ending among all urls differ by no more
    than chance, the branch becomes the node's wildcard. A branch that stays apart is followed at once as
    far as its paths agree, so there are as many rounds as levels at which paths part or end; below ``LEVELS`` levels, only
    nodes that could still be rejected are followed. Counting before every join leaves one row per branch, whatever share
    of all urls a host has.
    """
    counts = urls.groupBy("host", segments(F.col("path")).alias("segs")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("label") == "block").alias("b"),
        F.count_if(F.col("label") == "allow").alias("a"),
    )
    tree = written(counts.withColumns({"template": F.lit(""), "level": F.lit(0)}), "templates")
    while not (open_ := tree.filter(F.size("segs") > F.col("level"))).isEmpty():
        own = F.get("segs", F.col("level"))
        rest = F.slice("segs", F.col("level") + 1, F.size("segs"))
        ends = F.when(F.size("segs") == F.col("level") + 1, F.col("n")).otherwise(0)
        branches = open_.groupBy("host", "template", own.alias("seg"), "level").agg(
            F.sum("n").alias("bn"), F.sum("b").alias("bb"), F.sum("a").alias("ba"), F.sum(ends).alias("be"),
            F.min(rest).alias("first"), F.max(rest).alias("last"),
        )
        nodes = branches.groupBy("host", "template").agg(
            F.sum("bn").alias("nn"), F.sum("bb").alias("nb"), F.sum("ba").alias("na"), F.sum("be").alias("ne")
        )
        alike = (F.col("nn") > F.col("bn")) & _labels_alike() & _alike("be", "bn", "ne", "nn")
        # All paths of a branch begin with what its first and its last one have in common.
        parting = F.array_position(F.zip_with("first", "last", lambda x, y: x.eqNullSafe(y)), F.lit(False)).cast("int")
        common = F.when(parting > 0, F.slice("first", F.lit(1), parting - 1)).otherwise(F.col("first"))
        named = branches.join(nodes, ["host", "template"]).withColumn("alike", alike)
        named = named.withColumn("passed", F.when(F.col("alike"), F.array(F.lit(WILDCARD))).otherwise(common)).select(
            "host",
            "template",
            "seg",
            F.concat("template", F.lit("/"), F.array_join("passed", "/")).alias("next"),
            F.size("passed").alias("more"),
            ((F.col("level") >= LEVELS) & (F.col("nb") < LEAST_BLOCKED)).alias("settled"),
        )
        below = tree.withColumn("seg", own).join(named, ["host", "template", "seg"], "left")
        # No template below a settled node can be rejected, so its paths keep the rest of theirs.
        whole = F.concat("template", F.lit("/"), F.array_join(F.slice("segs", F.col("level") + 1, F.size("segs")), "/"))
        below = below.withColumns(
            {
                "next": F.when(F.col("settled"), whole).otherwise(F.col("next")),
                "more": F.when(F.col("settled"), F.size("segs") - F.col("level")).otherwise(F.col("more")),
            }
        )
        step = (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")
        tree = written(below.select("host", "segs", "n", "b", "a", F.coalesce("next", "template").alias("template"), step), "templates")
    totals = tree.groupBy("host", "template").agg(
        F.sum("n").alias("urls"), F.sum("b").alias("blocked"), F.sum("a").alias("allowed")
    )
    purity = (F.col("blocked") + SMOOTHING / 2) / (F.col("blocked") + F.col("allowed") + SMOOTHING)
    return tree.select("host", "segs", "template").join(totals.withColumn("purity", purity), ["host", "template"])


def judged(
    pages: DataFrame, rules: Sequence[Rule], url: str = "url", page_id: str = "page_id", label: str | None = None
) -> DataFrame:
    """One row per page: (page_id, host, path, rule, verdict, template, purity).

    The verdict is that of the rule, else ``block`` where the template's purity reaches ``REJECT_FROM``, else ``allow``.
    ``label`` may name a column with labels of its own, which a sample of the urls has; otherwise the rules' verdicts are
    the labels. A url that is null
    or has no ``://`` has an empty host and path, the empty template, and is allowed as long as no label says otherwise.
    Repeated rows are judged each; an empty table gives no rows.
    """
    host, path = parsed(F.col(url).cast("string"))
    rows = pages.select(
        F.col(page_id).alias("page_id"),
        host.alias("host"),
        path.alias("path"),
        (F.col(label) if label else F.lit(None).cast("string")).alias("own"),
    )
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), "own")
    labelled = rows.select("host", "path", (F.col("own") if label else F.col("ruled")).alias("label"))
    tree = template_tree(labelled)
    found = rows.withColumn("segs", segments(F.col("path"))).join(tree, ["host", "segs"])
    by_method = F.when(F.col("purity") >= REJECT_FROM, "block").otherwise("allow")
    return found.select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", by_method).alias("verdict"), "template", "purity"
    )
