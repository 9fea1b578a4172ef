"""Operator 3, URL filters: explicit rules, and a tree of path templates for each host.

Rules. A rule `host/path` fits its host and all subdomains when the url's path starts with the rule's; the longest wins.

Templates. A host's paths form a tree of segments. (1) Variable segments become wildcards: runs of digits {n}, long hex
{h}, and {s} for literals of fewer than `support` urls below a node where such a url's next neighbour is likely to bring a
new literal: singletons are at least `variable` of the node's urls (Good-Turing's estimate of what is unseen) and at least
`support`; better supported literals stay. (2) Branches of a node are merged into one, {m}, where a two-proportion test
finds their share of blocked urls no different from their siblings'. (3) A template is rejected if its labelled purity,
smoothed by a prior of half with weight `prior`, reaches `purity`. Labelled urls are those that rules decide, or whatever
label column is given.

Branches without a labelled url back off to the nearest node above them that has labelled branches, up to the host, then
to the hosts of the same parent domain. They inherit if they look like the labelled ones there: their urls' shapes below
the node overlap in at least `alike` of the two distributions. What they inherit is the mean purity of that node's labelled
branches, drawn towards the mean of all nodes of the level by as much as branches within nodes differ more than nodes do
(the shrinkage of a random-effects model), so labels of siblings count for little in a corpus where siblings disagree. It
needs two labelled branches somewhere below one node to be told at all. Without anything to inherit, a template is allowed.

Scale. Urls are combined to counts of (host, template) before anything else, within each task first, so a host with a
third of all rows sends one row per template and task; the tree's levels are aggregates and joins over those counts, down
to the last level where two paths of a host can part. With `depth`, what follows that many segments is one wildcard.

Defined cases: a url that is null or has no `://` has an empty host and path, fits no rule, and is judged with its like;
very long paths count with all their segments; equal rules: the first counts; repeated rows are judged alike; empty tables
work; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_one, settle, table, unsettle

SUPPORT, VARIABLE, ALIKE, Z, PRIOR, PURITY = 5, 0.3, 0.5, 1.64, 2.0, 0.8
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    whole = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(whole, pattern, 1), _UPPER, _LOWER), F.regexp_extract(whole, pattern, 2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null without one. Of equal rules the first counts."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(reversed(rules), key=lambda r: len(r[0])):
        on, slash, rest = rule.partition("/")
        fits = ((host == on) | host.endswith("." + on)) & path.startswith(slash + rest)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def shapes(path: Column, depth: int | None) -> Column:
    """The path's segments with digits and hex as wildcards; with depth so many, and ** for what follows them."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    shaped = F.transform(F.slice(parts, 1, depth) if depth else parts, lambda s: F.regexp_replace(F.regexp_replace(s, "^[0-9a-f]{16,}$", "{h}"), "[0-9]+", "{n}"))
    return shaped if not depth else F.when(F.size(parts) > depth, F.concat(shaped, F.array(F.lit("**")))).otherwise(shaped)


def _with(segments: Column, k: int, value: str) -> Column:
    """The segments with the k-th one (from 0) replaced."""
    return F.concat(F.slice(segments, 1, k), F.array(F.lit(value)), F.slice(segments, k + 2, 1 << 20))


def levels(counts: DataFrame) -> int:
    """How many levels have a node that two shapes of a host reach; below them nothing is generalised or merged."""
    sizes = counts.groupBy("host", F.size("shape").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    reached = sizes.withColumn("n", F.sum("n").over(Window.partitionBy("host").orderBy(F.desc("size"))))
    return reached.where("n > 1").agg(F.max("size")).first()[0] or 0


def _backed(t: DataFrame, node: list[Column], branch: Column, tail: Column, alike: float) -> DataFrame | None:
    """(at, s, inherited) for branches s of nodes `at` that have no labelled url, but labelled siblings that they resemble;
    None if labels tell nothing at this level. What several steps read is written, or each of them would plan it anew, and
    plans that repeat each other's parts fill the driver."""
    x = t.select(F.struct(*node).alias("at"), branch.alias("s"), tail.alias("tail"), "urls", "labelled", "blocked")
    branches = settle(x.groupBy("at", "s").agg(*(F.sum(c).alias(c) for c in ("urls", "labelled", "blocked"))))
    share = F.when(F.col("labelled") > 0, F.col("blocked") / F.col("labelled"))
    nodes = branches.groupBy("at").agg(F.count(share).alias("m"), F.avg(share).alias("mean"), F.coalesce(F.var_pop(share), F.lit(0.0)).alias("spread"), F.count(F.lit(1)).alias("all")).where("m > 0")
    # Of the level: the mean of nodes, how much branches vary within nodes, and how much nodes vary beyond that.
    of_level = nodes.agg(F.avg("mean").alias("mu"), F.sum(F.col("m") * F.col("spread")).alias("w"), F.sum(F.col("m") - 1).alias("free"), F.coalesce(F.var_pop("mean"), F.lit(0.0)).alias("v"), F.avg(1 / F.col("m")).alias("r"))
    within = F.try_divide("w", "free")
    of_level = of_level.where("free > 0").select("mu", within.alias("within"), F.greatest(F.lit(0.0), F.col("v") - within * F.col("r")).alias("between")).first()
    if of_level is None:
        unsettle(branches)
        return None
    mu, within, between = (F.lit(of_level[c]) for c in ("mu", "within", "between"))
    weight = F.coalesce(F.try_divide(between, between + within / F.col("m")), F.lit(0.0))
    some = settle(nodes.where("m < all").select("at", (mu + weight * (F.col("mean") - mu)).alias("inherited")))
    # The overlap of an unlabelled branch's tails with those of its labelled siblings together.
    marked = settle(x.join(some.select("at"), "at", "left_semi").join(branches.select("at", "s", (F.col("labelled") > 0).alias("known")), ["at", "s"]))
    known = marked.where("known").groupBy("at", "tail").agg(F.sum("urls").alias("n"))
    known = known.join(known.groupBy("at").agg(F.sum("n").alias("of")), "at").select("at", "tail", (F.col("n") / F.col("of")).alias("q"))
    own = marked.where("not known").groupBy("at", "s", "tail").agg(F.sum("urls").alias("n")).join(branches.select("at", "s", F.col("urls").alias("of")), ["at", "s"])
    overlap = own.join(known, ["at", "tail"]).groupBy("at", "s").agg(F.sum(F.least(F.col("n") / F.col("of"), F.col("q"))).alias("overlap")).where(F.col("overlap") >= alike)
    back = settle(overlap.join(some, "at").select("at", "s", "inherited"))
    for done in (branches, some, marked):
        unsettle(done)
    return back


def templates(counts: DataFrame, depth: int, support: int = SUPPORT, variable: float = VARIABLE, z: float = Z, alike: float = ALIKE) -> DataFrame:
    """counts: (host, shape, urls, labelled, blocked). Adds template, the shape generalised and merged level by level, and
    inherited, what a template without labelled urls has from its nearest labelled relatives."""
    t = counts.withColumn("template", F.col("shape"))
    literal = lambda k: (F.size("template") > k) & ~F.coalesce(F.get("template", F.lit(k)), F.lit("")).rlike(r"\{|\*")
    for k in range(depth):
        here = t.withColumns({"above": F.slice("template", 1, k), "s": F.get("template", F.lit(k))})
        kinds = here.where(literal(k)).groupBy("host", "above", "s").agg(F.sum("urls").alias("n"))
        open_ = kinds.groupBy("host", "above").agg(F.sum("n").alias("of"), F.count(F.when(F.col("n") == 1, 1)).alias("once")).where((F.col("once") >= support) & (F.col("once") >= F.lit(variable) * F.col("of")))
        few = kinds.where(F.col("n") < support).join(open_, ["host", "above"], "left_semi").select("host", "above", "s", F.lit(True).alias("few"))
        t = here.join(few, ["host", "above", "s"], "left").withColumn("template", F.when(F.col("few"), _with(F.col("template"), k, "{s}")).otherwise(F.col("template"))).drop("few", "above", "s")
        t = _next(t)  # each level's plan stays small
    t = t.withColumn("inherited", F.lit(None).cast("double"))
    for k in range(depth):
        branch = t.where(F.size("template") > k).groupBy("host", F.slice("template", 1, k).alias("above"), F.get("template", F.lit(k)).alias("s")).agg(F.sum("labelled").alias("n"), F.sum("blocked").alias("b"))
        node = branch.groupBy("host", "above").agg(F.sum("n").alias("nn"), F.sum("b").alias("bb"))
        both = branch.where("n > 0").join(node, ["host", "above"]).where("nn > n")
        share = F.col("bb") / F.col("nn")
        gap = F.abs(F.col("b") / F.col("n") - (F.col("bb") - F.col("b")) / (F.col("nn") - F.col("n")))
        error = F.sqrt(share * (1 - share) * (1 / F.col("n") + 1 / (F.col("nn") - F.col("n"))))
        same = both.where(gap <= z * error).select("host", "above", "s", F.lit(True).alias("same"))
        back = _backed(t.where(F.size("template") > k), [F.col("host"), F.slice("template", 1, k).alias("above")], F.get("template", F.lit(k)), F.slice("template", k + 2, 1 << 20), alike)
        t = t.withColumns({"above": F.slice("template", 1, k), "s": F.get("template", F.lit(k))}).join(same, ["host", "above", "s"], "left")
        t = t.join(back.select("at.host", "at.above", "s", F.col("inherited").alias("back")), ["host", "above", "s"], "left") if back is not None else t.withColumn("back", F.lit(None).cast("double"))
        t = t.withColumn("template", F.when(F.col("same") & literal(k), _with(F.col("template"), k, "{m}")).otherwise(F.col("template"))).withColumn("inherited", F.coalesce("back", "inherited")).drop("above", "s", "same", "back")
        t = _next(t)
    domain = F.regexp_extract("host", r"\.(.*)", 1)
    back = _backed(t.where(domain != ""), [domain.alias("domain")], F.col("host"), F.col("shape"), alike)
    return t.join(back.select(F.col("s").alias("host"), F.col("inherited").alias("back")), "host", "left").withColumn("inherited", F.coalesce("inherited", "back")).drop("back") if back is not None else t


def _next(t: DataFrame) -> DataFrame:
    """t written, and what it was read from deleted."""
    out = settle(t)
    unsettle(t)
    return out


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", label: Column | None = None, depth: int | None = None, support: int = SUPPORT, variable: float = VARIABLE, alike: float = ALIKE, z: float = Z, prior: float = PRIOR, purity: float = PURITY) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, template, score (the template's smoothed purity, or what it
    inherits), labelled (how many urls of the template are). label: a boolean column of pages, true for urls known to be bad;
    null where unknown; by default what the rules say."""
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), *([label.alias("bad")] if label is not None else []))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "says": says, "shape": shapes(F.col("path"), depth)})
    if label is None:
        rows = rows.withColumn("bad", F.col("says") == "block")
    counts = settle(rows.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("urls"), F.count("bad").alias("labelled"), F.count(F.when(F.col("bad"), 1)).alias("blocked")))
    tree = settle(templates(counts, depth or levels(counts), support, variable, z, alike))
    pooled = tree.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"), F.max("inherited").alias("inherited"), F.sum("urls").alias("n"))
    smoothed = (F.col("blocked") + F.lit(prior / 2)) / (F.col("labelled") + F.lit(prior))
    score = F.when(F.col("labelled") > 0, smoothed).otherwise(F.coalesce("inherited", F.lit(0.5)))
    pooled = pooled.select("host", "template", score.alias("score"), "labelled", ((score >= purity) & ((F.col("labelled") > 0) | F.col("inherited").isNotNull())).alias("reject"))
    judged = settle(tree.select("host", "shape", "template", F.col("urls").alias("n")).join(pooled, ["host", "template"]).withColumn("template", F.concat(F.lit("/"), F.array_join("template", "/"))))
    for done in (counts, tree):
        unsettle(done)
    method = F.when(F.col("reject"), "block").otherwise("allow")
    return join_one(rows, judged, ["host", "shape"], F.xxhash64("id", "path")).select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("says", method).alias("verdict"), "template", "score", "labelled")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), RULES)
