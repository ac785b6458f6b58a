"""URL filter: longest rule first, else a tree of path templates per host (native functions only)."""
import string

from pyspark.sql import Window, functions as F

from headwise.llm.common import fields, write_and_read

#: (verdict, host, path): a rule fits its host and all subdomains.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: A segment keeps its name below a node when it has this many rows and this share of them, or so many rows that
#: it is well supported whatever the size of the node.
MIN_SUPPORT = 5
MIN_SHARE = 0.02
WELL_SUPPORTED = 50
#: Segments beyond this depth form one last segment.
MAX_DEPTH = 6
#: Weight of the prior in labelled rows, and the purity from which a template is rejected.
PRIOR_WEIGHT = 4.0
MIN_PURITY = 0.8
#: The prior alone never leans to rejection, however many of the labels are bad.
MAX_PRIOR = 0.5
#: What an unlabelled row weighs against rejection on a host with labels of both kinds: a pure template needs labels
#: for a third of its rows. Where rules only block, what they leave out is no sample, and each such row counts in full.
UNLABELLED_WEIGHT = 0.125
#: Neighbouring branches whose rates differ by fewer standard errors are merged.
MERGE_Z = 1.64


def url_parts(url):
    """Host (A-Z lower-cased) and path as the text says; without ``://`` or for null both are empty."""
    text = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(text, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(text, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def longest_rule(host, path, rules=RULES):
    """The rule's name and verdict, or nulls; of two rules of one length the alphabetically first wins."""
    name = verdict = F.lit(None).cast("string")
    for what, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]), reverse=True):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def _segments(path, max_depth):
    """Path segments with runs of digits generalised; what lies beyond ``max_depth`` is one segment."""
    parts = F.array_remove(F.split(F.regexp_replace(path, r"[0-9]+", "#"), "/"), "")
    tail = F.array_join(F.slice(parts, max_depth, F.greatest(F.size(parts), F.lit(1))), "/")
    return F.when(F.size(parts) <= max_depth, parts).otherwise(
        F.concat(F.slice(parts, 1, max_depth - 1), F.array(tail)))


def _grow(paths, depth):
    """Extend every template by its segment at ``depth``: by name if frequent or well supported, else ``*``."""
    here = paths.filter(F.size("segs") >= depth).select("host", "tmpl", F.get("segs", F.lit(depth - 1)).alias("seg"), "n")
    kids = here.groupBy("host", "tmpl", "seg").agg(F.sum("n").alias("kid_n"))
    nodes = kids.groupBy("host", "tmpl").agg(F.sum("kid_n").alias("node_n"))
    named = kids.join(nodes, ["host", "tmpl"]).filter(
        (F.col("kid_n") >= MIN_SUPPORT)
        & ((F.col("kid_n") >= MIN_SHARE * F.col("node_n")) | (F.col("kid_n") >= WELL_SUPPORTED))
    ).select("host", "tmpl", "seg", F.lit(True).alias("named"))
    named = write_and_read(named, "branches")
    grown = paths.withColumn("seg", F.get("segs", F.lit(depth - 1))).join(named, ["host", "tmpl", "seg"], "left")
    step = F.when(F.col("seg").isNull(), "").otherwise(
        F.concat(F.lit("/"), F.when(F.col("named"), F.col("seg")).otherwise("*")))
    return grown.withColumn("tmpl", F.concat("tmpl", step)).drop("seg", "named")


def template_tree(paths, max_depth=MAX_DEPTH):
    """Templates of all distinct generalised paths.

    ``paths`` has host, segs, n, labelled, bad. Level by level each node keeps its frequent children and
    folds the others into a wildcard; a level is one aggregation with partial sums.
    """
    tree = paths.withColumn("tmpl", F.lit(""))
    depth = paths.agg(F.max(F.size("segs"))).first()[0] or 0
    for level in range(1, min(depth, max_depth) + 1):
        tree = write_and_read(tree.transform(_grow, level), "tree")
    return tree


def judge_templates(tree, prior_weight=PRIOR_WEIGHT, min_purity=MIN_PURITY, merge_z=MERGE_Z):
    """One row per (host, tmpl) with its branch, smoothed purity and verdict.

    The rate of a branch is that of bad labels in its evidence: its labelled rows, and its unlabelled ones by
    weight. Labelled branches of one host and depth are put in order of it, and neighbours that a two-proportion
    test cannot tell apart share their counts, if the host has labels of both kinds. A branch without labels
    has at most the prior, the overall rate of bad labels up to ``MAX_PRIOR``, and stays.
    """
    templates = tree.groupBy("host", "tmpl").agg(
        F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"),
        F.first(F.size("segs")).alias("depth"),
    )
    templates = write_and_read(templates, "templates")
    total = templates.agg(F.sum("bad"), F.sum("labelled")).first()
    prior = min(MAX_PRIOR, total[0] / total[1]) if total[1] else 0.0
    hosts = write_and_read(templates.groupBy("host").agg((F.sum("labelled") > F.sum("bad")).alias("mixed")), "hosts")
    weight = F.when(F.col("mixed"), UNLABELLED_WEIGHT).otherwise(1.0)
    templates = templates.join(hosts, "host").withColumn(
        "evidence", F.col("labelled") + weight * (F.col("n") - F.col("labelled")))
    rate = F.when(F.col("labelled") > 0, F.try_divide(F.col("bad"), F.col("evidence")))
    order = Window.partitionBy("host", "depth").orderBy(rate.asc_nulls_last(), "tmpl")
    before_n, before_bad = F.lag("evidence").over(order), F.lag("bad").over(order)
    pooled = (F.col("bad") + before_bad + 0.5) / (F.col("evidence") + before_n + 1)
    error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1), F.col("evidence")) + F.try_divide(F.lit(1), before_n)))
    # Null, hence apart, at the first branch and where either side has no labels.
    alike = F.col("mixed") & F.coalesce(rate - F.lag(rate).over(order) <= merge_z * error, F.lit(False))
    split = templates.withColumn("new", F.when(alike, 0).otherwise(1))
    branch = split.withColumn("branch", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    shared = Window.partitionBy("host", "depth", "branch")
    purity = (F.sum("bad").over(shared) + F.lit(prior * prior_weight)) / (
        F.sum("evidence").over(shared) + F.lit(prior_weight))
    return branch.withColumn("purity", purity).select(
        "host", "tmpl", "branch", "purity",
        F.when(F.col("purity") >= min_purity, "block").otherwise("allow").alias("learned"))


def filter_urls(pages, rules=RULES):
    """Verdict of every page: page_id, host, path, rule, template, purity, verdict.

    Rules decide first, and their verdicts label the urls from which the templates of each host are judged.
    Repeated rows are judged one by one, null urls belong to the empty host, an empty table gives no rows.
    """
    host, path = url_parts(F.col("url"))
    urls = fields(pages, "page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    urls = urls.select(
        "*", rule.alias("rule"), verdict.alias("ruled"), _segments(F.col("path"), MAX_DEPTH).alias("segs"))
    paths = write_and_read(urls.groupBy("host", "segs").agg(
        F.count(F.lit(1)).alias("n"), F.count("ruled").alias("labelled"),
        F.sum((F.coalesce(F.col("ruled") == "block", F.lit(False))).cast("long")).alias("bad"),
    ), "paths")
    tree = template_tree(paths)
    learned = write_and_read(
        tree.select("host", "segs", "tmpl").join(judge_templates(tree), ["host", "tmpl"]), "learned")
    return urls.join(learned, ["host", "segs"], "left").select(
        "page_id", "host", "path", "rule", F.col("tmpl").alias("template"), "purity",
        F.coalesce("ruled", "learned", F.lit("allow")).alias("verdict"))
