"""URL filters: a list of host and path rules, and association rules over URL tokens for what the list leaves open."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.llm.common import lower_ascii, materialize, read_table

MIN_SUPPORT = 0.005
MIN_COUNT = 10
MIN_CONFIDENCE = 0.9
#: Rows of more items are mined level by level: FP-growth would list all subsets of what they have in common.
WIDE = 12
BLOCK = "verdict=block"
ALLOW = "verdict=allow"


@dataclass(frozen=True)
class ListRule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    ListRule("net", "/", "block"),
    ListRule("example.net", "/en/", "allow"),
    ListRule("example.com", "/de/", "block"),
    ListRule("org", "/fr/", "allow"),
)


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; then up to "?", "#" or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def listed(host: Column, path: Column, rules: tuple[ListRule, ...] = RULES) -> Column:
    """The name of the longest rule that fits the host or a domain above it, and the start of the path; else null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        out = F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), r.name).otherwise(out)
    return out


def tokens(url: Column, host: Column, path: Column) -> Column:
    """What a URL is made of: each label of the host and the parts of one with hyphens, the path's segments, the query's keys."""
    tag = lambda name, parts: F.transform(F.array_remove(parts, ""), lambda x: F.concat(F.lit(name), x))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, "^[^=]*", 0))
    return F.array_distinct(F.concat(tag("host:", F.split(host, r"\.")), tag("word:", F.flatten(F.transform(F.filter(F.split(host, r"\."), lambda x: x.contains("-")), lambda x: F.split(x, "-")))), tag("path:", F.split(path, "/")), tag("key:", keys)))


def matches(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, rule_id): every rule whose antecedent is part of a set. sets: id, tokens; rules: rule_id, antecedent, key.

    An inverted index: a rule is looked up by its key, one token of its antecedent, and then compared whole.
    """
    each = sets.select("id", "tokens", F.explode("tokens").alias("key"))
    return each.join(rules.select("rule_id", "antecedent", "key"), "key").filter(F.size(F.array_except("antecedent", "tokens")) == 0).select("id", "rule_id")


def defining(rules: tuple[ListRule, ...] = RULES) -> list[str]:
    """The tokens that the list's own rules are made of. They tell its verdicts, not what the URLs have in common."""
    hosts = {f"host:{x}" for r in rules for x in r.host.split(".")}
    return sorted(hosts | {f"path:{x}" for r in rules for x in r.path.split("/") if x})


def _grown(labelled: DataFrame, min_support: float, min_confidence: float) -> DataFrame:
    """antecedent, n, n_block of the rules for BLOCK that FP-growth finds. labelled: tokens, verdict."""
    items = labelled.select(F.array_union("tokens", F.array(F.concat(F.lit("verdict="), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    wanted = F.array_contains("consequent", BLOCK) & ~F.array_contains("antecedent", ALLOW)
    rules = model.associationRules.filter(wanted).select(F.sort_array("antecedent").alias("antecedent"), "confidence")
    seen = model.freqItemsets.filter(~F.array_contains("items", BLOCK)).select(F.sort_array("items").alias("antecedent"), F.col("freq").alias("n"))
    return rules.join(seen, "antecedent").select("antecedent", "n", F.round(F.col("confidence") * F.col("n")).cast("long").alias("n_block"))


def _levels(labelled: DataFrame, least: float, min_confidence: float) -> DataFrame:
    """antecedent, n, n_block of the least rules for BLOCK, from combinations of 1, 2, ... tokens in turn.

    A combination is taken further if it is no rule yet, at least `least` blocked rows have it, and each of its tokens
    makes a difference: one that all rows with the others have as well can't be part of a least rule. So of tokens that
    always come together, or in a chain, no two are combined, however many a row has.
    """
    weighed = labelled.groupBy(F.sort_array("tokens").alias("tokens")).agg(F.count("*").alias("n"), F.sum((F.col("verdict") == "block").cast("long")).alias("n_block"))
    sets = materialize(weighed.filter(F.size("tokens") > 0).withColumn("id", F.monotonically_increasing_id()), "url-sets")
    within = sets.select("id", "n", "n_block", F.explode("tokens").alias("t")).select("id", "n", "n_block", F.array("t").alias("x"))
    found, size, before = [], 1, None
    while True:
        counted = within.groupBy("x").agg(F.sum("n").alias("n"), F.sum("n_block").alias("n_block")).filter(F.col("n_block") >= least)
        if before is not None:
            parts = counted.select("x", F.col("n").alias("own"), F.explode(F.transform("x", lambda t: F.array_remove("x", t))).alias("part"))
            parts = parts.join(before.select(F.col("x").alias("part"), F.col("n").alias("n_part")), "part").groupBy("x").agg(F.count("*").alias("of"), F.min(F.col("n_part") - F.col("own")).alias("fewer"))
            counted = counted.join(parts.filter((F.col("of") == size) & (F.col("fewer") > 0)).select("x"), "x")
        counted = materialize(counted, "url-levels")
        rule = F.col("n_block") >= min_confidence * F.col("n")
        found.append(counted.filter(rule))
        before = counted.filter(~rule)
        if before.isEmpty():
            break
        open_ = materialize(within.select("id", "x").join(before.select("x"), "x"), "url-combinations")
        if size == 1:
            singles = open_.groupBy("id").agg(F.sort_array(F.collect_list(F.element_at("x", 1))).alias("singles"))
            sets = materialize(sets.drop("tokens").join(singles, "id"), "url-sets")
        after = F.explode(F.filter("singles", lambda t: t > F.element_at("x", -1)))
        within = open_.join(sets, "id").select("id", "n", "n_block", "x", after.alias("t")).select("id", "n", "n_block", F.concat("x", F.array("t")).alias("x"))
        size += 1
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.withColumnRenamed("x", "antecedent")


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, wide: int = WIDE, omit: list[str] | None = None) -> DataFrame:
    """rule_id, antecedent, key, confidence, support: token combinations that mean "block", from (id, tokens, verdict).

    Of the rules for BLOCK those of enough confidence stay, and of these only the least: a rule that another one's
    antecedent is part of says nothing new. A combination needs min_support of the rows and MIN_COUNT rows, so at most
    (tokens in a row) / min_support tokens are frequent, and rules don't grow with the number of rows. Tokens to omit are in no rule.

    Only tokens that may be part of a longer rule are combined: those that enough blocked rows have and that are no rule by
    themselves. FP-growth combines them; where a row has more than `wide` of them, _levels() finds the same least rules.
    """
    total = labelled.count()
    least = max(min_support * total, MIN_COUNT)
    kept = labelled.select(F.array_except("tokens", F.array(*map(F.lit, omit or [""]))).alias("tokens"), "verdict")
    one = kept.select(F.explode("tokens").alias("t"), (F.col("verdict") == "block").cast("long").alias("block")).groupBy("t").agg(F.count("*").alias("n"), F.sum("block").alias("n_block"))
    one = materialize(one.filter(F.col("n_block") >= least), "url-tokens")
    rule = F.col("n_block") >= min_confidence * F.col("n")
    numbered = materialize(kept.withColumn("_id", F.monotonically_increasing_id()), "url-rows")
    open_ = numbered.select("_id", "verdict", F.explode("tokens").alias("t")).join(one.filter(~rule).select("t"), "t")
    narrow = materialize(open_.groupBy("_id", "verdict").agg(F.collect_list("t").alias("tokens")).drop("_id"), "url-rows")
    rows, widest = narrow.agg(F.count("*"), F.max(F.size("tokens"))).first()
    rules = one.filter(rule).select(F.array("t").alias("antecedent"), "n", "n_block")
    if rows >= least:
        more = _grown(narrow, least / rows, min_confidence) if widest <= wide else _levels(narrow, least, min_confidence)
        rules = rules.unionByName(more.select("antecedent", "n", "n_block"))
    rules = rules.select("antecedent", (F.col("n_block") / F.col("n")).alias("confidence"), (F.col("n_block") / F.lit(max(total, 1))).alias("support"))
    rules = rules.withColumn("rule_id", F.concat_ws(" ", "antecedent"))
    rarest = rules.select("rule_id", F.explode("antecedent").alias("key")).join(one.select(F.col("t").alias("key"), "n"), "key").groupBy("rule_id").agg(F.min_by("key", F.struct("n", "key")).alias("key"))
    rules = materialize(rules.join(rarest, "rule_id"), "url-rules")
    within = matches(rules.select(F.col("rule_id").alias("id"), F.col("antecedent").alias("tokens")), rules)
    wider = within.filter(F.col("id") != F.col("rule_id")).select(F.col("id").alias("rule_id")).distinct()
    return rules.join(wider, "rule_id", "left_anti")


def judge(pages: DataFrame, rules: tuple[ListRule, ...] = RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rules of every row of pages (page_id, url).

    The URLs that the list decides are the labels from which combinations are mined, of tokens that its rules don't
    name; what the list leaves open is blocked
    if a mined rule matches, and allowed otherwise. Null URLs and those without "://" have an empty host and path, and
    are allowed. Repeated rows are judged each for itself; an empty table, or one without a listed URL, mines no rules.
    """
    host, path = split_url(F.col("url"))
    urls = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    urls = urls.withColumn("rule", listed(F.col("host"), F.col("path"), rules))
    verdicts = F.create_map(*(F.lit(x) for r in rules for x in (r.name, r.verdict)))
    urls = urls.withColumn("_listed", F.when(F.col("rule").isNotNull(), F.element_at(verdicts, F.col("rule"))))
    urls = urls.withColumn("tokens", F.when(F.col("url").isNotNull(), tokens(F.col("url"), F.col("host"), F.col("path"))).otherwise(F.array().cast("array<string>")))
    urls = materialize(urls, "urls")
    labelled = urls.filter(F.col("_listed").isNotNull()).select(F.col("tokens"), F.col("_listed").alias("verdict"))
    mined = mine(labelled, min_support, min_confidence, omit=defining(rules))
    # equal token sets are looked up once; what the list decides needs no look-up
    open_urls = urls.filter(F.col("_listed").isNull()).withColumn("id", F.concat_ws(" ", F.sort_array("tokens")))
    sets = open_urls.select("id", F.sort_array("tokens").alias("tokens")).distinct()
    hits = matches(sets, mined).groupBy("id").agg(F.sort_array(F.collect_set("rule_id")).alias("mined_rules"))
    looked_up = open_urls.join(hits, "id", "left").withColumn("verdict", F.when(F.col("mined_rules").isNotNull(), "block").otherwise("allow"))
    decided = urls.filter(F.col("_listed").isNotNull()).withColumns({"mined_rules": F.array().cast("array<string>"), "verdict": F.col("_listed")})
    cols = ["page_id", "host", "path", "rule", "verdict", F.coalesce(F.concat_ws("; ", "mined_rules"), F.lit("")).alias("mined_rules")]
    return looked_up.select(*cols).unionByName(decided.select(*cols))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "pages").select("page_id", "url"))
