"""URL filters: host rules, and a path-template tree that rejects templates by smoothed labelled purity.

Only DataFrame functions: no Python runs on the executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidlens.llm.common import UPPER, stored, table

# Rules as (verdict, host and path).
RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]
# A node with so many children is generalised: children with fewer pages than SUPPORT become a wildcard.
VARIETY = 8
SUPPORT = 8
# Children are merged while their rates of bad labels differ by fewer standard errors than this.
SIMILAR = 1.96
# Weight of the prior in pages, and the smoothed share of bad labels from which a template is rejected.
PRIOR = 5.0
REJECT = 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty without ``://`` or for null."""
    start = F.locate("://", url)
    rest = F.when(start > 0, F.substring(url, start + F.lit(3), F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, UPPER.lower()), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """Longest fitting rule and its verdict, else nulls; of equally long ones the first in order."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, rule in sorted(rules, key=lambda r: (len(r[1]), r[1], r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        text, verdict = F.when(fits, F.lit(rule)).otherwise(text), F.when(fits, F.lit(say)).otherwise(verdict)
    return text, verdict


def segments(path: Column) -> Column:
    """Path segments with obviously variable ones as a class: numbers, hexadecimal, mixed with digits, long."""

    def general(s: Column) -> Column:
        stem, tail = F.regexp_extract(s, r"(?s)^(.*?)(\.[A-Za-z]{1,5})?$", 1), F.regexp_extract(s, r"(?s)^(.*?)(\.[A-Za-z]{1,5})?$", 2)
        kind = (
            F.when(stem.rlike(r"^[0-9]+$"), "{number}")
            .when(stem.rlike(r"^[0-9a-fA-F]{8,}$"), "{hex}")
            .when(stem.rlike("[0-9]"), "{mixed}")
            .when(F.length(stem) > 32, "{long}")
            .otherwise(stem)
        )
        return F.concat(kind, F.lower(tail))

    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(parts, general)


def past_chains(now: DataFrame) -> DataFrame:
    """``now`` (host, segs, template, level, ...) with every node moved down to the level at which its paths part.

    A node's paths are held against the longest of them: up to the first level at which one differs, the node has one child
    a level, which is neither rare among many nor merged, so its template is the segments themselves. Paths that end
    before are complete.
    """
    open_ = now.where(F.size("segs") > F.col("level"))
    longest = open_.groupBy("host", "template").agg(F.max(F.struct(F.size("segs").alias("size"), "segs")).alias("longest"))
    rest, other = (F.slice(c, F.col("level") + 1, F.size(c)) for c in ("segs", "longest.segs"))
    differs = F.array_position(F.zip_with(rest, other, lambda a, b: a.eqNullSafe(b)), False).cast("int")
    parts = F.when((differs > 0) & (differs <= F.size(rest)), F.col("level") + differs - 1)
    at = open_.join(longest, ["host", "template"]).withColumns({"parts": parts, "most": F.col("longest.size")}).drop("longest")
    at = stored(at, "url-chains")
    until = at.groupBy("host", "template").agg(F.coalesce(F.min("parts"), F.max("most")).alias("until"))
    to = F.least(F.size("segs"), "until")
    own = F.slice("segs", F.col("level") + 1, F.greatest(F.col("to") - F.col("level"), F.lit(0)))
    moved = at.join(until, ["host", "template"]).withColumn("to", to)
    template = F.when(F.col("to") > F.col("level"), F.concat("template", F.lit("/"), F.array_join(own, "/"))).otherwise(F.col("template"))
    return moved.select("host", "segs", "n", "labelled", "bad", template.alias("template"), F.col("to").alias("level"))


def template_tree(pages: DataFrame) -> DataFrame:
    """Templates of distinct (host, segs): rows (host, segs, template, purity, n_labelled).

    ``pages`` has host, segs (array of segments) and bad (1, 0 or null where unlabelled). Level by level, a
    node's rare children become ``*`` if it has many, and children whose share of bad labels does not
    differ from their siblings' are merged into ``~``. Levels at which a node has one child are passed at
    once (``past_chains``), so rounds are as many as the levels at which paths part, not as the deepest path has.
    Work is on counts per distinct path, combined map-side; a hot host is one row per distinct path there.
    """
    every = pages.groupBy("host", "segs").agg(
        F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")
    )
    now = stored(every.withColumn("template", F.lit("")).withColumn("level", F.lit(0)), "url-paths")
    total = now.agg(F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum("labelled"), F.lit(0))).first()
    overall = (total[0] + 1.0) / (total[1] + 2.0)
    done = []
    while True:
        # Paths without a further segment are set aside.
        done.append(now.where(F.size("segs") <= F.col("level")))
        now = stored(past_chains(now), "url-parting")
        done.append(now.where(F.size("segs") <= F.col("level")))
        at = now.where(F.size("segs") > F.col("level")).withColumn("seg", F.get("segs", F.col("level")))
        if at.isEmpty():
            break
        child = at.groupBy("host", "template", "seg").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
        node = child.groupBy("host", "template").agg(F.count("*").alias("variety"))
        joined = child.join(node, ["host", "template"])
        named = joined.withColumn("name", F.when((F.col("variety") >= VARIETY) & (F.col("n") < SUPPORT), "*").otherwise(F.col("seg")))
        branch = named.groupBy("host", "template", "name").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
        whole = branch.groupBy("host", "template").agg(F.sum("l").alias("tl"), F.sum("b").alias("tb"), F.count("*").alias("branches"))
        rest_l, rest_b = F.col("tl") - F.col("l"), F.col("tb") - F.col("b")
        share = F.col("tb") / F.greatest(F.col("tl"), F.lit(1))
        apart = F.abs(F.col("b") / F.greatest("l", F.lit(1)) - rest_b / F.greatest(rest_l, F.lit(1)))
        error = F.sqrt(share * (1 - share) * (1 / F.greatest("l", F.lit(1)) + 1 / F.greatest(rest_l, F.lit(1))))
        alike = (F.col("l") == 0) | (rest_l == 0) | (apart <= SIMILAR * error)
        merged = branch.join(whole, ["host", "template"]).select(
            "host", "template", "name", F.when(alike & (F.col("branches") > 1) & (F.col("name") != "*"), "~").otherwise(F.col("name")).alias("step")
        )
        step = named.select("host", "template", "seg", "name").join(merged, ["host", "template", "name"]).select("host", "template", "seg", "step")
        now = at.join(step, ["host", "template", "seg"]).select(
            "host", "segs", "n", "labelled", "bad", F.concat("template", F.lit("/"), "step").alias("template"), (F.col("level") + 1).alias("level")
        )
        now = stored(now, "url-level")
    now = stored(reduce(DataFrame.unionByName, done), "url-templates")
    hosts = now.groupBy("host").agg(((F.sum("bad") + PRIOR * overall) / (F.sum("labelled") + PRIOR)).alias("prior"))
    leaf = now.groupBy("host", "template").agg(F.sum("bad").alias("b"), F.sum("labelled").alias("l")).join(hosts, "host")
    purity = leaf.select("host", "template", ((F.col("b") + PRIOR * F.col("prior")) / (F.col("l") + PRIOR)).alias("purity"), F.col("l").alias("n_labelled"))
    return now.select("host", "segs", "template").join(purity, ["host", "template"])


def url_filter(pages: DataFrame, labelled: DataFrame, rules=None, reject: float = REJECT) -> DataFrame:
    """Verdicts of ``pages`` (page_id, url): page_id, host, path, rule, verdict, template, purity, n_labelled.

    ``labelled`` has (page_id, bad): the largest label of a page_id counts, null labels and ids do not.
    A fitting rule decides; else a page is blocked if its template's smoothed share of bad labels reaches
    ``reject``, the prior being its host's share. A template without labels is allowed. A null url or one
    without ``://`` has empty host and path, and is judged as the pages alike. Every row gives a row;
    further columns of ``pages`` are not used.
    """
    host, path = host_and_path(F.col("url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), list(RULES if rules is None else rules))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path")).withColumns({"rule": rule, "said": verdict, "segs": segments(F.col("path"))})
    known = labelled.where("page_id is not null").groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad")).where("bad is not null")
    tree = template_tree(parsed.select("page_id", "host", "segs").join(known, "page_id", "left").select("host", "segs", "bad"))
    judged = F.when((F.col("purity") >= reject) & (F.col("n_labelled") > 0), "block").otherwise("allow")
    return parsed.join(tree, ["host", "segs"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("said", judged).alias("verdict"), "template", "purity", "n_labelled"
    )


def labels_of_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Bad (toxic or of low quality) or good, for pages whose path ends in the number of a labelled document."""
    number = F.expr("try_cast(nullif(regexp_extract(url, '://[^/?#]*[^?#]*/([0-9]+)[^/?#]*/?(?:[?#]|$)', 1), '') as bigint)")
    marks = [F.coalesce(F.col("toxic") == 1, F.lit(False)), F.coalesce(F.col("quality") == 0, F.lit(False))]
    known = labels.where("toxic is not null or quality is not null").select("doc_id", reduce(lambda a, b: a | b, marks).cast("int").alias("bad"))
    return pages.select("page_id", number.alias("doc_id")).where("doc_id is not null").join(known, "doc_id").select("page_id", "bad")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter(pages, labels_of_pages(pages, table(spark, sf_dir, "labels")))
