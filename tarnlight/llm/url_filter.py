"""URL filter: rules decide what they fit, a tree of path templates of each host decides the rest.

A path's segments lead down the tree of its host.  At each node a segment stays a constant if it has at least ``support`` pages
and ``share`` of the node's; others become wildcards, of the shape of their digits where that shape is as frequent
(``{*}.html``), else of any (``{*}``).  Branches of a node are compared with the node as a whole:
by a chi-square test on the shapes of what follows, and on the labels below them.  Those that don't differ are merged
(``{en|es}``).  The pages that rules allow or block are the labelled ones.  A node's purity is its share of
allowed pages, smoothed by ``weight`` pages of its parent's purity, and that of a host by as many of 0.5; pages
of templates with a purity below ``reject`` are blocked.

Defined results: the host is what stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased,
the path goes on up to ``?``, ``#`` or the end; a null URL, or one without ``://``, has an empty host and path, and
such pages are a host of their own.  A rule fits its host and all its subdomains, and paths that start
with its path; the longest rule wins (host and path together, then the longer host, then the one named first).  Hosts
without labelled pages are allowed.  Repeated rows count each time; ids may be null; an empty table gives none.
Segments beyond ``depth`` are one segment, so paths of any length are judged.  Only ``page_id`` and ``url`` are read.

Scale: each level is an aggregation by node and segment, reduced on the map side first, so a hot host is a row a task
and segment, and two joins with the table of nodes, in which a node has at most ``2 / share`` branches whatever its pages: by broadcast
below Spark's threshold, else by a shuffle in which Spark splits a hot node's pages.  Each level is written, so a lost executor
costs tasks of one level.  Hosts are never gathered.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlight.llm.shared import StepTables

SUPPORT, SHARE, WEIGHT, REJECT, DEPTH = 3, 0.02, 4.0, 0.25, 16
Z = 3.09  #: normal quantile of the merge test, one in a thousand
NODE = ["_host", "_template"]


class Rule(NamedTuple):
    host: str
    path: str
    allow: bool


#: The rules of the registered query.
RULES = (Rule("org", "/", True), Rule("example.org", "/es/", False), Rule("example.org", "/en/1", False), Rule("com", "/fr/", True), Rule("com", "/de/", False))


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; both empty where there is no ``://``."""
    after = F.coalesce(F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))), F.lit(""))
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def by_rules(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """(the winning rule as text, whether it allows); both null where none fits."""
    name, allow = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for r in reversed(sorted(rules, key=lambda r: (-len(r.host + r.path), -len(r.host)))):  # the last condition added is tried first
        fits = ((host == r.host) | F.endswith(host, F.lit(f".{r.host}"))) & F.startswith(path, F.lit(r.path))
        name, allow = F.when(fits, r.host + r.path).otherwise(name), F.when(fits, r.allow).otherwise(allow)
    return name, allow


def segments(path: Column, depth: int) -> Column:
    """The segments behind the first slash; those beyond ``depth`` are one."""
    cells = F.split(F.regexp_replace(path, "^/", ""), "/", -1)
    deep = F.concat(F.slice(cells, 1, depth - 1), F.array(F.array_join(F.slice(cells, F.lit(depth), F.greatest(F.size(cells) - depth + 1, F.lit(0))), "/")))
    return F.when(path == "", F.array().cast("array<string>")).when(F.size(cells) > depth, deep).otherwise(cells)


def shape(segment: Column) -> Column:
    """The segment with a mark for each run of digits."""
    return F.regexp_replace(segment, "[0-9]+", "{*}")


def kind(segment: Column) -> Column:
    """A coarse shape: marks for runs of digits and of other characters but dots; ``$`` where there is no segment."""
    return F.coalesce(F.regexp_replace(F.regexp_replace(segment, r"[^0-9.]+", "a"), "[0-9]+", "0"), F.lit("$"))


def _plain(segment: Column) -> Column:
    return F.replace(F.replace(segment, F.lit("{"), F.lit("%7B")), F.lit("}"), F.lit("%7D"))


def branches(pages: DataFrame, support: int, share: float) -> DataFrame:
    """(node, _constants, _shapes): the segments and shapes of each node that are frequent enough to stand for themselves."""
    own = pages.select(*NODE, _plain(F.get("_rest", F.lit(0))).alias("_seg"))
    marked = F.when(F.contains(F.col("_seg"), F.lit("{*}")) | F.col("_seg").rlike("[0-9]"), F.struct(F.lit("shape").alias("kind"), shape(F.col("_seg")).alias("value")))
    each = F.array(F.struct(F.lit("all").alias("kind"), F.lit("").alias("value")), F.struct(F.lit("constant").alias("kind"), F.col("_seg").alias("value")), marked)
    counts = own.select(*NODE, F.explode(F.array_compact(each)).alias("_x")).groupBy(*NODE, "_x.kind", "_x.value").agg(F.count("*").alias("_n"))
    totals = counts.filter("kind = 'all'").select(*NODE, F.col("_n").alias("_all"))
    frequent = counts.filter((F.col("kind") != "all") & (F.col("_n") >= support)).join(totals, NODE).filter(F.col("_n") >= share * F.col("_all"))
    return frequent.groupBy(*NODE).agg(*[F.collect_list(F.when(F.col("kind") == k, F.col("value"))).alias(f"_{k}s") for k in ("constant", "shape")])


def with_branch(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """``pages`` with ``_branch``: the next segment as a constant or wildcard, and ``_next``: the coarse shape of the one after it."""
    seg = _plain(F.get("_rest", F.lit(0)))
    held = lambda cells, x: F.coalesce(F.array_contains(cells, x), F.lit(False))
    branch = F.when(held(F.col("_constants"), seg), seg).when(held(F.col("_shapes"), shape(seg)), shape(seg)).otherwise(F.lit("{*}"))
    return pages.join(nodes, NODE, "left").withColumns({"_branch": branch, "_next": kind(F.get("_rest", F.lit(1)))}).drop("_constants", "_shapes")


def critical(df: Column) -> Column:
    """The chi-square value that one in a thousand exceeds (Wilson and Hilferty's approximation)."""
    v = 2 / (9 * df)
    return df * F.pow(1 - v + Z * F.sqrt(v), 3)


def merged(pages: DataFrame, weight: float) -> DataFrame:
    """(node, _branch, _name, _child): what each branch is called once like branches are merged, and the purity below it."""
    cells = pages.groupBy(*NODE, "_branch", "_next").agg(F.count("*").alias("_n"), F.count_if("_allow").alias("_g"), F.count_if(~F.col("_allow")).alias("_b"), F.first("_purity").alias("_purity"))
    pool = cells.groupBy(*NODE, "_next").agg(F.sum("_n").alias("_pn"))
    node = cells.groupBy(*NODE).agg(F.sum("_n").alias("_all"), F.sum("_g").alias("_ng"), F.sum("_b").alias("_nb"), F.count_distinct("_next").alias("_kinds"))
    total = cells.groupBy(*NODE, "_branch").agg(F.sum("_n").alias("_bn"), F.sum("_g").alias("_bg"), F.sum("_b").alias("_bb"), F.first("_purity").alias("_purity"))
    # The sum of (seen - expected)^2 / expected is that of seen^2 / expected less the branch's pages.
    seen = cells.join(pool, [*NODE, "_next"]).groupBy(*NODE, "_branch").agg(F.sum(F.col("_n") * F.col("_n") / F.col("_pn")).alias("_fit"))
    found = total.join(seen, [*NODE, "_branch"]).join(node, NODE)
    labelled = (F.col("_bg") + F.col("_bb") > 0) & (F.col("_ng") > 0) & (F.col("_nb") > 0)
    share = lambda c: F.col(f"_b{c}") * F.col(f"_b{c}") * (F.col("_ng") + F.col("_nb")) / (F.col(f"_n{c}") * (F.col("_bg") + F.col("_bb")))
    labels = F.when(labelled, share("g") + share("b") - (F.col("_bg") + F.col("_bb"))).otherwise(0.0)
    chi = F.round(F.col("_fit") * F.col("_all") / F.col("_bn") - F.col("_bn") + labels, 9)
    df = F.col("_kinds") - 1 + labelled.cast("int")
    found = found.withColumn("_like", (df == 0) | (chi <= critical(F.greatest(df, F.lit(1)))))
    group = found.groupBy(*NODE, F.when(F.col("_like"), F.lit("")).otherwise(F.col("_branch")).alias("_group"))
    groups = group.agg(F.array_sort(F.collect_list("_branch")).alias("_names"), F.sum("_bg").alias("_g"), F.sum("_bb").alias("_b"), F.first("_purity").alias("_purity"))
    name = F.when(F.size("_names") == 1, F.get("_names", F.lit(0))).otherwise(F.concat(F.lit("{"), F.array_join("_names", "|"), F.lit("}")))
    purity = (F.col("_g") + weight * F.col("_purity")) / (F.col("_g") + F.col("_b") + weight)
    return groups.select(*NODE, F.explode("_names").alias("_branch"), name.alias("_name"), purity.alias("_child"))


def templates(pages: DataFrame, support: int = SUPPORT, share: float = SHARE, weight: float = WEIGHT, depth: int = DEPTH) -> DataFrame:
    """``pages`` (with ``_host``, ``_path`` and ``_allow``, null where unlabelled) with ``_template`` and ``_purity``."""
    tables = StepTables(pages, "templates")
    own = tables.keep(pages.withColumn("_rest", segments(F.col("_path"), depth)))
    hosts = own.groupBy("_host").agg(((F.count_if("_allow") + weight * 0.5) / (F.count("_allow") + weight)).alias("_purity"))
    levels = own.agg(F.max(F.size("_rest"))).first()[0] or 0
    own = own.join(tables.keep(hosts), "_host").withColumn("_template", F.lit(""))
    done = []
    for _ in range(levels):
        done.append(own.filter(F.size("_rest") == 0))
        going = tables.keep(own.filter(F.size("_rest") > 0))
        nodes, _path = tables.write(branches(going, support, share))
        going = tables.keep(with_branch(going, nodes))
        names = tables.keep(merged(going, weight))
        down = going.join(names, [*NODE, "_branch"])
        own = down.withColumns({"_template": F.concat("_template", F.lit("/"), "_name"), "_purity": F.col("_child"), "_rest": F.slice("_rest", F.lit(2), F.size("_rest"))}).drop("_branch", "_next", "_name", "_child")
    for part in done:
        own = own.unionByName(part)
    return own.drop("_rest")


def url_filter(pages: DataFrame, rules: tuple[Rule, ...] = RULES, page_id: str = "page_id", url: str = "url", reject: float = REJECT, **tree) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of each page; ``tree`` are parameters of :func:`templates`."""
    host, path = parts(F.col(url))
    own = pages.select(F.col(page_id).alias("page_id"), host.alias("_host"), path.alias("_path"))
    name, allow = by_rules(F.col("_host"), F.col("_path"), rules)
    judged = templates(own.withColumns({"_rule": name, "_allow": allow}), **tree)
    verdict = F.when(F.coalesce("_allow", F.col("_purity") >= reject), "allow").otherwise("block")
    return judged.select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), verdict.alias("verdict"), F.col("_template").alias("template"), F.round("_purity", 9).alias("purity"))
