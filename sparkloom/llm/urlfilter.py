"""URL filter: a path-template tree per host, and a list of explicit rules.

Level by level, runs without branches at once, the path segments under a host's node are generalised: segments with digits, and all segments of a node
with very many children, become wildcards; branches whose share of labelled bad pages doesn't differ significantly
from their siblings' merge into the wildcard too; a branch with too few labels to tell is judged by the same branch on all
hosts, and merges if MIN_HOSTS of them can't tell either. A template is rejected when its
smoothed bad share reaches REJECT: its own labels count, and so do those of the same template on other hosts, so hosts
that no label reaches are judged by what the template is like elsewhere. Labels come from the rules' own verdicts
(block: bad) and, if given, from labelled URLs. Explicit rules always win.

Only counts of distinct generalised paths are grouped, pre-aggregated; no host's URLs meet in one task.

Defined results: a null URL or one without "://" has empty host and path, no rule and the verdict allow; ties between
rules of one length go to the first listed; repeated rows are judged each, alike; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WILD = "*"
#: A node whose branches are more than this, and than this share of its pages, has a variable segment.
MANY_CHILDREN, CHILD_SHARE = 32, 0.5
MIN_LABELLED = 5
#: Hosts with labels of a template that make it count on others.
MIN_HOSTS = 5
Z = 1.96
REJECT = 0.9
#: The share that a template with few labels of its own must reach.
REJECT_AFAR = 0.98
PRIOR = 2.0
#: (verdict, rule): a host, a slash and the start of a path.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    after = F.regexp_extract(url, "(?s)^.*?://(.*)$", 1)  # empty where there is no ://
    host = F.translate(F.regexp_extract(after, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; nulls if none fits."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule in reversed(sorted(rules, key=lambda r: -len(r[1]))):  # the longest is asked first
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        text, verdict = F.when(fits, F.lit(rule)).otherwise(text), F.when(fits, F.lit(what)).otherwise(verdict)
    return text, verdict


def _differs(child_bad: Column, child_n: Column, bad: Column, n: Column) -> Column:
    """Whether a branch's bad share differs from its siblings' (two-proportion test); siblings without labels differ."""
    rest_n, rest_bad = n - child_n, bad - child_bad
    pooled = F.try_divide(bad, n)
    spread = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1), child_n) + F.try_divide(F.lit(1), rest_n)))
    gap = F.abs(F.try_divide(child_bad, child_n) - F.try_divide(rest_bad, rest_n))
    return (rest_n == 0) | ((spread > 0) & (gap > Z * spread))


def segments(path: Column) -> Column:
    """A path's segments, those with digits as wildcards; empty ones don't count."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.transform(parts, lambda x: F.when(x.rlike("[0-9]"), WILD).otherwise(x))


def _common(low: Column, high: Column) -> Column:
    """Length of the common start of arrays of which low is the least and high the largest."""
    same = F.zip_with(low, high, lambda a, b: a.eqNullSafe(b))
    return F.when(F.array_position(same, F.lit(False)) > 0, F.array_position(same, F.lit(False)) - 1).otherwise(F.size(same)).cast("int")


def _longer(template: Column, segs: Column) -> Column:
    """A template with more segments."""
    return F.when(F.size(segs) > 0, F.concat(template, F.lit("/"), F.array_join(segs, "/"))).otherwise(template)


#: What a node's paths do in a round.
_END, _RUN, _BRANCH = 0, 1, 2


def templates(paths: DataFrame) -> DataFrame:
    """host, segs (distinct), n, labels, bad -> with the template of each: branches of a node merge.

    A round decides one level of the nodes that branch. Runs in which nothing branches take one round, whatever their
    length: branches of few labels are judged by all hosts' only while MIN_HOSTS hosts have labels at the template, so
    a node beyond that is a wildcard to the end if its own labels are few, and keeps the common start of its paths if
    they are enough; and where all hosts' paths at a template share a start, all keep it. Finished paths leave."""
    moved = checkpoint(paths.withColumn("template", F.lit("")).withColumn("at", F.lit(0)))
    finished, left = [moved.where(F.size("segs") == 0)], moved.where(F.size("segs") > 0)
    while not left.isEmpty():
        rest = F.slice("segs", F.col("at") + 1, F.greatest(F.size("segs") - F.col("at"), F.lit(0)))
        node = checkpoint(left.groupBy("host", "template").agg(F.sum("labels").alias("_own"), F.min(rest).alias("_low"), F.max(rest).alias("_high")))
        whole = node.groupBy(F.col("template").alias("_at")).agg(F.sum("_own").alias("_all"), F.count_if(F.col("_own") > 0).alias("_hosts"), F.min("_low").alias("_least"), F.max("_high").alias("_most"))
        alive = (F.col("_all") >= MIN_LABELLED) & (F.col("_hosts") >= MIN_HOSTS)
        own = F.col("_own") >= MIN_LABELLED
        run = F.when(alive, _common(F.col("_least"), F.col("_most"))).otherwise(_common(F.col("_low"), F.col("_high")))
        act = F.when(~alive & ~own, _END).when(run > 0, _RUN).otherwise(_BRANCH)
        known = node.join(whole, F.col("template") == F.col("_at")).select(F.col("host").alias("_h"), F.col("template").alias("_t"), act.alias("_act"), run.alias("_run"))
        acted = checkpoint(left.join(known, (F.col("host") == F.col("_h")) & (F.col("template") == F.col("_t"))).drop("_h", "_t"))
        ended = acted.where(F.col("_act") == _END).withColumns({"template": _longer(F.col("template"), F.transform(rest, lambda _: F.lit(WILD))), "at": F.size("segs")})
        ran = acted.where(F.col("_act") == _RUN).withColumns({"template": _longer(F.col("template"), F.slice("segs", F.col("at") + 1, F.col("_run"))), "at": F.col("at") + F.col("_run")})
        branched = _one_level(acted.where(F.col("_act") == _BRANCH))
        moved = checkpoint(ended.unionByName(ran).unionByName(branched).drop("_act", "_run"))
        finished.append(moved.where(F.size("segs") <= F.col("at")))
        left = moved.where(F.size("segs") > F.col("at"))
    return reduce(DataFrame.unionByName, finished).drop("at")


def _one_level(at: DataFrame) -> DataFrame:
    """Paths at nodes that branch, each with its template one segment longer: the segment itself or a wildcard."""
    here = F.get("segs", F.col("at"))
    seen = at.withColumn("seg", here).groupBy("host", "template", "seg").agg(F.sum("n").alias("n"), F.sum("labels").alias("labels"), F.sum("bad").alias("bad"))
    node = seen.groupBy(F.col("host").alias("_h"), F.col("template").alias("_t")).agg(F.count("*").alias("_kids"), F.sum("n").alias("_n"), F.sum("labels").alias("_labels"), F.sum("bad").alias("_nbad"))
    many = (F.col("_kids") > MANY_CHILDREN) & (F.col("_kids") > CHILD_SHARE * F.col("_n"))
    # the same branches on all hosts, for those that have too few labels of their own
    wide = seen.groupBy(F.col("template").alias("_wt"), F.col("seg").alias("_ws")).agg(F.sum("labels").alias("_wl"), F.sum("bad").alias("_wb"), F.count_if(F.col("labels") > 0).alias("_wh"))
    whole = seen.groupBy(F.col("template").alias("_at")).agg(F.sum("labels").alias("_al"), F.sum("bad").alias("_ab"))
    wide = wide.join(whole, F.col("_wt") == F.col("_at")).where((F.col("_wl") >= MIN_LABELLED) & (F.col("_wh") >= MIN_HOSTS))
    sure = lambda bad, n, all_bad, all_n: F.coalesce(_differs(F.col(bad), F.col(n), F.col(all_bad), F.col(all_n)), F.lit(False))
    enough = F.col("labels") >= MIN_LABELLED
    apart = (enough & sure("bad", "labels", "_nbad", "_labels")) | (~enough & F.col("_wt").isNotNull() & sure("_wb", "_wl", "_ab", "_al"))
    known = seen.join(node, (F.col("host") == F.col("_h")) & (F.col("template") == F.col("_t"))).join(wide, (F.col("template") == F.col("_wt")) & (F.col("seg") == F.col("_ws")), "left")
    kept = known.where((F.col("seg") != WILD) & ~many & apart).select("_h", "_t", F.col("seg").alias("_s"))
    on = (F.col("host") == F.col("_h")) & (F.col("template") == F.col("_t")) & (here == F.col("_s"))
    longer = F.concat("template", F.lit("/"), F.coalesce("_s", F.lit(WILD)))
    return at.join(checkpoint(kept), on, "left").withColumns({"template": longer, "at": F.col("at") + 1}).drop("_h", "_t", "_s")


def rejected(leaves: DataFrame) -> DataFrame:
    """host, segs, template, labels, bad -> host, segs, template, reject.

    A template's bad share is smoothed towards that of the same template on all hosts, if MIN_HOSTS of them have labels
    of it, and towards its host's else; these are smoothed towards the whole table's. It is rejected at REJECT if it has
    MIN_LABELLED labels, and at REJECT_AFAR if only the same template elsewhere has them."""
    own = checkpoint(leaves.groupBy("host", "template").agg(F.sum("labels").alias("labels"), F.sum("bad").alias("bad")))
    total = own.agg(F.sum("labels"), F.sum("bad")).first()
    everywhere = (total[1] / total[0]) if total and total[0] else 0.5
    by_host = own.groupBy(F.col("host").alias("_h")).agg(F.sum("labels").alias("_hl"), F.sum("bad").alias("_hb"))
    labelled = own.where("labels > 0")
    by_shape = checkpoint(labelled.groupBy(F.col("template").alias("_t")).agg(F.sum("labels").alias("_sl"), F.sum("bad").alias("_sb"), F.count("*").alias("_hosts")))
    j = own.join(by_host, F.col("host") == F.col("_h")).join(by_shape, F.col("template") == F.col("_t"), "left")
    smooth = lambda bad, n, prior: (F.col(bad) + PRIOR * prior) / (F.col(n) + PRIOR)
    wide = F.coalesce(F.col("_hosts") >= MIN_HOSTS, F.lit(False))
    prior = F.when(wide, smooth("_sb", "_sl", F.lit(everywhere))).otherwise(smooth("_hb", "_hl", F.lit(everywhere)))
    own_labels, purity = F.col("labels") >= MIN_LABELLED, smooth("bad", "labels", prior)
    reject = (own_labels & (purity >= REJECT)) | (~own_labels & wide & (F.col("_sl") >= MIN_LABELLED) & (purity >= REJECT_AFAR))
    judged = j.select(F.col("host").alias("_h"), F.col("template").alias("_t"), reject.alias("reject"))
    return leaves.join(judged, (F.col("host") == F.col("_h")) & (F.col("template") == F.col("_t"))).select("host", "segs", "template", "reject")


def judge(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, template of every page. labelled: (url, bad 0/1) rows to learn from as well."""
    def parsed(df: DataFrame, url: Column, *more: Column) -> DataFrame:
        host, path = host_and_path(F.coalesce(url, F.lit("")))
        df = df.select(host.alias("host"), path.alias("path"), *more)
        text, verdict = rule_of(F.col("host"), F.col("path"), rules)
        return df.select("*", text.alias("rule"), verdict.alias("_ruled"), segments(F.col("path")).alias("segs"))

    own = parsed(pages, F.col(f"`{url}`"), F.col(f"`{page_id}`").alias("page_id"))
    ruled = F.when(F.col("_ruled") == "block", 1).when(F.col("_ruled") == "allow", 0)
    learn = own.select("host", "segs", ruled.alias("_bad"))
    if labelled is not None:
        more = parsed(labelled, F.col("url"), F.col("bad").cast("int").alias("_given"))
        learn = learn.unionByName(more.select("host", "segs", F.coalesce("_given", ruled).alias("_bad")))
    paths = learn.groupBy("host", "segs").agg(F.count("*").alias("n"), F.count("_bad").alias("labels"), F.coalesce(F.sum("_bad"), F.lit(0)).alias("bad"))
    found = checkpoint(rejected(templates(paths))).select(F.col("host").alias("_h"), F.col("segs").alias("_s"), "template", "reject")
    out = own.join(found, (F.col("host") == F.col("_h")) & (F.col("segs") == F.col("_s")), "left")
    by_tree = F.when((F.col("host") != "") & F.coalesce("reject", F.lit(False)), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("_ruled", by_tree).alias("verdict"), "template")
