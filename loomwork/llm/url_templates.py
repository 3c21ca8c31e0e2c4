"""URL filtering with rules and a tree of path templates per host.

Paths of a host become a tree of segments. Digits and long hexadecimal runs are generalised first. Then, level by level, the
children of a node are merged by what their labelled pages say: those whose share of blocked pages does not differ
significantly from all their siblings' are one branch, those that do are merged with the children that differ alike, in steps
of a fifth. Children without a label join a branch only where the segment is shown to be variable, by two labelled siblings of
the same form, all in that branch; the others are merged by form and learn nothing from their siblings. A template is rejected
when its share of blocked labelled pages, smoothed towards its host's, reaches a threshold.

Only DataFrame functions are used. All steps after the first grouping work on the distinct (host, shape) pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, settled

#: (host, path, verdict); the longest fitting rule, host and path together, decides.
Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return ascii_lower(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The fitting rule as text and its verdict, or nulls. Rules are a parameter of a few entries, not data."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # later ones are longer and go in front
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def shape_of(path: Column) -> Column:
    """Hashes as {#} and numbers as {0}, which no letter stands in, so that a segment's form keeps them apart."""
    return F.regexp_replace(F.regexp_replace(path, "[0-9a-fA-F]{12,}", "{#}"), "[0-9]+", "{0}")


def form_of(segment: Column) -> Column:
    """What a segment looks like: letters as a, runs of four and more of them as @, all else as it is."""
    return F.regexp_replace(F.regexp_replace(segment, "[A-Za-z]{4,}", "@"), "[A-Za-z]", "a")


def template_purity(shapes: DataFrame, depth: int, z: float, alpha: float, beta: float) -> DataFrame:
    """``shapes`` (host, shape, n, blocked, allowed; one row per pair) with template, purity."""
    keep = shapes.columns
    parts = F.split(F.regexp_replace("shape", "^/", ""), "/")
    tree = shapes
    for k in range(depth):
        tree = tree.withColumn(f"s{k}", F.coalesce(F.get(parts, F.lit(k)), F.lit("")))
    rest = F.concat_ws("/", F.slice(parts, F.lit(depth + 1), F.greatest(F.size(parts) - depth, F.lit(1))))
    tree = tree.withColumn(f"s{depth}", F.when(F.size(parts) > depth, rest).otherwise(""))
    for k in range(depth + 1):
        above = ["host", *(f"t{i}" for i in range(k))]
        nodes = tree.groupBy(*above, f"s{k}").agg(F.sum("blocked").alias("b"), F.sum("allowed").alias("a"))
        parents = nodes.groupBy(*above).agg(F.sum("b").alias("pb"), F.sum("a").alias("pa"))
        n, total = F.col("b") + F.col("a"), F.col("pb") + F.col("pa")
        share, own = F.col("pb") / total, F.col("b") / n
        apart = own - share
        similar = apart * apart * n <= z * z * (share * (1 - share) + 1 / total)
        fifth = F.least(F.floor(own * 5), F.lit(4)).cast("string")
        label = F.when(n == 0, None).when(similar, "~").when(apart > 0, F.concat(F.lit("+"), fifth)).otherwise(F.concat(F.lit("-"), fifth))
        labelled = nodes.join(parents, above).select(*above, f"s{k}", form_of(F.col(f"s{k}")).alias("form"), label.alias("branch"))
        forms = labelled.where("branch is not null").groupBy(*above, "form").agg(F.count("*").alias("known"), F.min("branch").alias("least"), F.max("branch").alias("most"))
        variable = forms.where("known >= 2 and least = most").select(*above, "form", F.col("least").alias("usual"))
        branch = F.coalesce("branch", "usual", F.concat(F.lit("?"), "form"))
        named = labelled.join(variable, [*above, "form"], "left").select(*above, f"s{k}", branch.alias(f"t{k}"))
        tree = settled(tree.join(named, [*above, f"s{k}"]))  # read twice by the next level; distinct shapes only
    tree = tree.withColumn("template", F.concat_ws("/", *(f"t{k}" for k in range(depth + 1))))
    hosts = tree.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("blocked").alias("hb"), F.sum("allowed").alias("ha"))
    # pages without a label count as half blocked, so that a host of few labels has a weak prior
    prior = (F.col("hb") + 0.5 * (F.col("hn") - F.col("hb") - F.col("ha") + beta)) / (F.col("hn") + beta)
    stats = tree.groupBy("host", "template").agg(F.sum("blocked").alias("tb"), F.sum("allowed").alias("ta"))
    purity = (F.col("tb") + alpha * F.col("prior")) / (F.col("tb") + F.col("ta") + alpha)
    # without a labelled page of its own a template is not rejected, however its host is seen
    learned = F.when(F.col("tb") + F.col("ta") > 0, purity).otherwise(F.least(purity, F.lit(0.5)))
    scored = stats.join(hosts.select("host", prior.alias("prior")), "host").select("host", "template", learned.alias("purity"))
    return tree.select(*keep, "template").join(scored, ["host", "template"])


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url",
    depth: int = 4, z: float = 2.58, alpha: float = 4.0, beta: float = 10.0, reject_at: float = 0.7, heavy: int = 1_000_000,
) -> DataFrame:
    """id, host, path, rule, verdict, template and purity for every row of ``pages``.

    Pages that a rule decides are the labelled ones from which templates learn; the rule's verdict stands for them. The first
    ``depth`` segments are levels of the tree and what follows them one more. Null urls and urls without ``://`` have an empty
    host and path and are judged like any other host; urls may be of any length. Repeated rows and ids give a row each; an
    empty table an empty result; further columns of ``pages``, whatever their names, are left out. ``heavy`` is the number of
    pages from which a (host, shape) is sent to them rather than they to it; it changes no result.
    """
    url = F.coalesce(F.col(url_col), F.lit(""))
    base = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    base = base.select("*", rule.alias("rule"), verdict.alias("ruled"), shape_of(F.col("path")).alias("shape"))
    count = lambda says: F.count(F.when(F.col("ruled") == says, 1))
    shapes = settled(base.groupBy("host", "shape").agg(F.count("*").alias("n"), count("block").alias("blocked"), count("allow").alias("allowed")))
    judged = settled(template_purity(shapes, depth, z, alpha, beta).select("host", "shape", "n", "template", "purity"))
    keys = ["host", "shape"]
    # at most one heavy pair for every ``heavy`` pages, so these are few; no other key of the second join has more rows
    often, seldom = judged.where(F.col("n") >= heavy).drop("n"), judged.where(F.col("n") < heavy).drop("n")
    met = base.join(F.broadcast(often), keys).select(*base.columns, "template", "purity")
    met = met.union(base.join(F.broadcast(often.select(*keys)), keys, "left_anti").join(seldom, keys).select(*base.columns, "template", "purity"))
    method = F.when(F.col("purity") >= reject_at, "block").otherwise("allow")
    return met.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "template", F.round("purity", 9).alias("purity"))
