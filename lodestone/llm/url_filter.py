"""URL filter: fixed rules first, then a path-template tree learned per host.

Everything here is DataFrame code. Pages are first reduced to distinct
(host, lexical path) templates with counts, so the tree levels work on a small
aggregate, whatever one host's share of the pages is.

The tree, level by level under each host, as deep as its paths go:

* lexical generalisation: digit, hexadecimal and mixed segments become
  placeholders, a known file ending is kept;
* statistical generalisation: below a parent with many distinct children, a
  child with a small share of the parent's pages becomes ``*``;
* merging: the remaining siblings with enough labels are ordered by their
  blocked share, and neighbours that a two-proportion test cannot tell apart
  form one branch;
* rejection: a template is blocked if its labelled purity reaches ``reject_at``.

Purity is smoothed by backing off. The share of blocked pages among all labelled
ones is the prior of a path's own prefixes over all hosts: (first segment), then
(first two), and so on, each smoothed towards the one before it, where it has
fewer labelled pages. What that gives
for a lexical path is the prior of the host's template with that path. So a
host without a label is judged by what its paths are elsewhere, and one with
labels by its own templates. A prefix is no host's property and is counted over
all of them; a label speaks for its whole path, so a prefix with both kinds of
pages decides nothing.

Node names escape the characters that they are made with, so a segment that
holds ``|``, ``*`` or ``{`` is never taken for a branch or a placeholder.

Defined results: a null url, or one without ``://``, has an empty host and
path, fits no rule and is allowed unless the template of the empty path is
rejected. Repeated rows get a row each. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A rule for a host with its subdomains and a path prefix."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class TreeConfig:
    variable_children: int = 10
    variable_share: float = 0.05
    min_labelled: int = 5
    similar_z: float = 1.96
    smoothing: float = 10.0
    reject_at: float = 0.9


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def best_rule(rules: list[Rule], host: Column, path: Column) -> Column:
    """Struct of the longest fitting rule's name and verdict, or null. The rule list is a parameter, so it is bounded."""
    found = []
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found.append(F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))))
    return F.coalesce(*found) if found else F.lit(None).cast("struct<rule:string,verdict:string>")


def lexical_segments(path: Column) -> Column:
    """Path segments, escaped, with variable-looking ones generalised."""

    def general(s: Column) -> Column:
        stem, ending = F.regexp_replace(s, r"\.[A-Za-z][A-Za-z0-9]{0,4}$", ""), F.regexp_extract(s, r"(\.[A-Za-z][A-Za-z0-9]{0,4})$", 1)
        kind = (
            F.when(stem.rlike("^[0-9]+$"), F.lit("{n}"))
            .when(stem.rlike("^[0-9a-fA-F-]{8,}$") & stem.rlike("[0-9]"), F.lit("{hex}"))
            .when((F.length(stem) >= 12) & stem.rlike("[0-9]") & stem.rlike("[A-Za-z]"), F.lit("{id}"))
            .when(F.length(stem) > 64, F.lit("{long}"))
        )
        return F.when(kind.isNull(), F.regexp_replace(s, r"([\\|*{}])", r"\\$1")).otherwise(F.concat(kind, ending))

    return F.transform(F.split(F.regexp_replace(path, "^/", ""), "/"), general)


def template_tree(templates: DataFrame, config: TreeConfig) -> DataFrame:
    """Give each (host, segs) row of counts the node of the learned tree that it ends in.

    ``templates`` has host, segs, pages, labelled, blocked; the result adds
    ``node``. A template that is alone in its node needs no further levels, so
    their number is that of the segments which templates of a host share.
    """
    at, done, level = templates.withColumn("node", F.lit("")), [], -1
    while True:
        level += 1
        crowd = at.groupBy("host", "node").agg((F.count("*") == 1).alias("alone"))
        at = saved(at.join(crowd, ["host", "node"]), f"nodes{level}")
        rest = F.array_join(F.slice("segs", F.lit(level + 1), F.greatest(F.size("segs") - level, F.lit(0))), "/")
        ended = F.col("alone") | (F.size("segs") <= level)
        done.append(at.where(ended).withColumn("node", F.when(F.size("segs") > level, F.concat("node", F.lit("/"), rest)).otherwise(F.col("node"))).select(*templates.columns, "node"))
        at = at.where(~ended).drop("alone")
        if at.isEmpty():
            break
        here = at.withColumn("seg", F.get("segs", F.lit(level)))
        children = (
            here.where(F.col("seg").isNotNull())
            .groupBy("host", "node", "seg")
            .agg(*(F.sum(c).alias(c) for c in ("pages", "labelled", "blocked")))
        )
        parents = children.groupBy("host", "node").agg(F.count("*").alias("siblings"), F.sum("pages").alias("parent_pages"))
        fixed = children.join(parents, ["host", "node"]).where(
            (F.col("siblings") < config.variable_children) | (F.col("pages") >= config.variable_share * F.col("parent_pages"))
        )
        # What is left has fewer than max(variable_children, 1 / variable_share) rows for each parent.
        tested = F.col("labelled") >= config.min_labelled
        w = Window.partitionBy("host", "node", "tested").orderBy("rate", "seg")
        before_n, before_b = F.lag("labelled").over(w), F.lag("blocked").over(w)
        rate, n = F.try_divide("blocked", "labelled"), F.col("labelled")
        pooled = F.try_divide(before_b + F.col("blocked"), before_n + n)
        spread = F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-9)) * (F.try_divide(F.lit(1.0), before_n) + F.try_divide(F.lit(1.0), n)))
        apart = F.coalesce(F.abs(F.try_divide(rate - F.try_divide(before_b, before_n), spread)) > config.similar_z, F.lit(True))
        run = w.rowsBetween(Window.unboundedPreceding, 0)
        branch = Window.partitionBy("host", "node", "tested", "run")
        named = (
            fixed.withColumn("tested", tested)
            .withColumn("rate", F.when(tested, rate).otherwise(0.0))
            .withColumn("apart", apart | ~F.col("tested"))
            .withColumn("run", F.sum(F.col("apart").cast("int")).over(run))
            .withColumn("branch", F.array_join(F.array_sort(F.collect_list("seg").over(branch)), "|"))
            .select("host", "node", "seg", "branch")
        )
        step = here.join(named, ["host", "node", "seg"], "left")
        grown = F.concat("node", F.lit("/"), F.coalesce("branch", F.lit("*")))
        at = saved(
            step.withColumn("node", F.when(F.col("seg").isNull(), F.col("node")).otherwise(grown)).select(*templates.columns, "node"),
            f"tree{level}",
        )
    return reduce(DataFrame.unionByName, done)


def backed_off(templates: DataFrame, config: TreeConfig) -> DataFrame:
    """host, segs, node and purity of templates with nodes: over hosts by the prefixes of their paths, then by the host's own node.

    A step with the same labelled pages as the one before adds nothing, so that no label counts again for each level it is deep.
    """
    overall = templates.agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("n")).first()
    first = F.struct(F.lit((overall["b"] or 0) / overall["n"] if overall["n"] else 0.0).alias("p"), F.lit(overall["n"] or 0).cast("long").alias("n"))

    def closer(known: Column, b: Column, n: Column) -> Column:
        value = (b + config.smoothing * known["p"]) / (n + config.smoothing)
        return F.when(n == known["n"], known).otherwise(F.struct(value.alias("p"), n.alias("n")))

    paths = templates.groupBy("segs").agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("n"))
    prefixes = paths.withColumn("level", F.explode(F.sequence(F.lit(1), F.size("segs"))))
    prefixes = prefixes.select("segs", "b", "n", "level", F.xxhash64(F.slice("segs", F.lit(1), F.col("level"))).alias("prefix"))
    shares = prefixes.groupBy("level", "prefix").agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
    steps = prefixes.select("segs", "level", "prefix").join(shares, ["level", "prefix"]).groupBy("segs")
    steps = steps.agg(F.array_sort(F.collect_list(F.struct("level", "b", "n"))).alias("steps"))  # one for each level of a path
    prior = steps.select("segs", F.aggregate("steps", first, lambda known, x: closer(known, x["b"], x["n"])).alias("prior"))
    nodes = templates.groupBy("host", "node").agg(F.sum("labelled").alias("n"), F.sum("blocked").alias("b"))
    own = templates.select("host", "segs", "node").join(nodes, ["host", "node"]).join(prior, "segs")
    return own.select("host", "segs", "node", closer(F.col("prior"), F.col("b"), F.col("n"))["p"].alias("purity"))


def filter_urls(pages: DataFrame, rules: list[Rule], config: TreeConfig = TreeConfig(), url: str = "url", label: str | None = None) -> DataFrame:
    """All columns given as ``_row`` struct, with host, path, rule and verdict.

    ``label`` names a column that is 1 for a page to block and 0 for one to
    keep; by default the pages that a rule judges are the labelled ones.
    """
    host, path = split_url(F.col(f"_row.`{url}`"))
    seen = pages.select(F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("_row")).withColumns({"host": host, "path": path})
    seen = seen.withColumn("_fit", best_rule(rules, F.col("host"), F.col("path")))
    given = F.col(f"_row.`{label}`") if label else F.when(F.col("_fit.verdict") == "block", 1).when(F.col("_fit").isNotNull(), 0)
    seen = seen.withColumn("segs", lexical_segments(F.col("path"))).withColumn("_label", given.cast("long"))
    counts = seen.groupBy("host", "segs").agg(
        F.count("*").alias("pages"), F.count("_label").alias("labelled"), F.coalesce(F.sum("_label"), F.lit(0)).alias("blocked")
    )
    templates = template_tree(saved(counts, "templates"), config)
    judged = saved(backed_off(templates, config), "judged")
    # Both sides are plain scans, so a host with a large share of the pages is split by adaptive execution.
    out = seen.join(judged, ["host", "segs"], "left")
    learned = F.when(F.col("purity") >= config.reject_at, F.lit("block")).otherwise(F.lit("allow"))
    return out.select(
        "_row", "host", "path", F.col("_fit.rule").alias("rule"), F.coalesce(F.col("_fit.verdict"), learned).alias("verdict"),
        F.col("node").alias("template"), "purity",
    )
