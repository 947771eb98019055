"""URL filters: a list of host and path rules, and association rules mined from labelled pages.

A rule of the list fits its host with all subdomains where the path starts with the rule's; the longest one
decides (of equally long ones that with the longer host). Other addresses are judged by rules that Spark's
FP-growth mines: an address is a set of tokens (words of host and path, the top domain, keys of the query;
numbers count as one word), a labelled page is one transaction, and a rule is a combination of tokens that
implies an unwanted page. A rule needs a least support, and even the lower end of its confidence's interval (Wilson,
``Z`` deviations) must reach ``MIN_CONFIDENCE``, so that no chance finding blocks clean pages; it goes if a
part of it is a rule at least as sure. Rules are found again by an inverted index: each lies under its rarest
token, and only there its other tokens are compared. Addresses with equal tokens are matched once.

A page is unwanted if its row in ``labels`` says toxic or of low quality; rows without either value don't
count, repeated ones count once, the worst value holds. All labelled pages are mined. A null address, or one
without ``://``, has no host, path or tokens and is allowed. Without labels there are no mined rules. Repeated
rows are judged alike. Further columns don't count.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridspark.llm.common import table, with_schema
from gridspark.llm.merkle import LOWER, UPPER
from gridspark.session import materialize

MIN_SUPPORT = 0.002  # share of the labelled pages
MIN_COUNT = 10  # and their least number
MIN_CONFIDENCE = 0.5
Z = 3.0
COMMON = 0.5  # tokens on a larger share of the labelled pages tell nothing
BLOCK = "!block"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The list the query judges by.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


# ---------------------------------------------------------------- addresses

_ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_BREAK = r"[\s\p{Punct}]+"


def host_of(url: Column) -> Column:
    host = F.translate(F.regexp_extract(url, _ADDRESS, 1), UPPER, LOWER)
    return F.coalesce(host, F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _ADDRESS, 2), F.lit(""))


def tokens_of(url: Column) -> Column:
    """The sorted distinct tokens of an address, marked by where they stand."""
    host, path = host_of(url), F.lower(path_of(url))
    query = F.lower(F.coalesce(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), F.lit("")))
    asked = F.when(host != "", F.split(query, "&")).otherwise(F.array().cast("array<string>"))

    def marked(words: Column, mark: str) -> Column:
        words = F.filter(words, lambda w: w != "")
        return F.transform(words, lambda w: F.concat(F.lit(mark), F.when(w.rlike("^[0-9]+$"), "#").otherwise(w)))

    parts = F.concat(
        marked(F.split(F.regexp_replace(host, r"\.[^.]*$", ""), _BREAK), "h:"),
        marked(F.array(F.regexp_extract(host, r"\.([^.]*)$", 1)), "d:"),
        marked(F.split(path, _BREAK), "p:"),
        marked(F.transform(asked, lambda a: F.substring_index(a, "=", 1)), "q:"),
    )
    return F.array_sort(F.array_distinct(parts))


def listed(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """The name and the verdict of the longest rule of a short list that fits, else null."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), len(r.host))):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


# ---------------------------------------------------------------- mining

MINED = "tokens array<string>, anchor string, support double, confidence double, sure double"


def transactions(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled pages: their tokens and whether they are unwanted."""
    unwanted = F.greatest(F.col("toxic").cast("int"), 1 - F.col("quality").cast("int"))
    known = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.max(unwanted).alias("unwanted")).where("unwanted IS NOT NULL")
    rows = pages.select(F.col("page_id").alias("_page"), tokens_of(F.col("url")).alias("tokens"))
    return rows.join(known, F.col("_page") == F.col("_id")).select("tokens", "unwanted")


def matches(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """``sets`` (tokens) with every rule whose tokens they hold (``r_`` columns)."""
    index = rules.select(*[F.col(c).alias(f"r_{c}") for c in rules.columns])
    each = sets.withColumn("_token", F.explode("tokens"))
    found = each.join(index, F.col("_token") == F.col("r_anchor"))
    return found.where(F.size(F.array_except("r_tokens", "tokens")) == 0).drop("_token")


def mine(
    labelled: DataFrame, min_support: float = MIN_SUPPORT, min_count: int = MIN_COUNT,
    min_confidence: float = MIN_CONFIDENCE, z: float = Z, common: float = COMMON,
) -> DataFrame:
    """Rules of ``labelled`` (tokens, unwanted), stored: tokens, rarest token, support, confidence, its lower end."""
    spark = labelled.sparkSession
    labelled = materialize(labelled, "url-labelled")
    n = labelled.count()
    if not n:
        return with_schema(spark, MINED)
    counts = materialize(
        labelled.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")), "url-tokens"
    )
    # at most the mean number of tokens over the share
    dull = [r["token"] for r in counts.where(F.col("n") > common * n).collect()]
    kept = F.array_except("tokens", F.array(*[F.lit(t) for t in dull]).cast("array<string>"))
    items = F.concat(kept, F.when(F.col("unwanted") == 1, F.array(F.lit(BLOCK))).otherwise(F.array().cast("array<string>")))
    model = FPGrowth(
        itemsCol="items", minSupport=min(1.0, max(min_support, min_count / n)), minConfidence=min_confidence
    ).fit(labelled.select(items.alias("items")))
    p, seen = F.col("confidence"), F.col("support") * n / F.col("confidence")
    lower = (p + z * z / (2 * seen) - z * F.sqrt(p * (1 - p) / seen + z * z / (4 * seen * seen))) / (1 + z * z / seen)
    found = model.associationRules.where(F.array_contains("consequent", BLOCK)).select(
        F.array_sort("antecedent").alias("tokens"), "support", "confidence", lower.alias("sure")
    )
    found = materialize(found.where(F.col("sure") >= min_confidence), "url-found")
    rarest = found.select("tokens", F.explode("tokens").alias("token")).join(counts, "token")
    rarest = rarest.groupBy("tokens").agg(F.min(F.struct("n", "token"))["token"].alias("anchor"))
    rules = materialize(found.join(rarest, "tokens").select("tokens", "anchor", "support", "confidence", "sure"), "url-rules")
    # a rule says no more than a part of it that is at least as sure
    parts = matches(rules.select("tokens", F.col("sure").alias("_sure")), rules)
    needless = parts.where((F.size("r_tokens") < F.size("tokens")) & (F.col("r_sure") >= F.col("_sure")))
    return materialize(rules.join(needless.select("tokens").distinct(), "tokens", "left_anti"), "url-mined")


def judge(pages: DataFrame, mined: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every page with host, path, the list's rule, the verdict, and the surest mined rule that fits."""
    url = F.col("url").cast("string")
    parsed = pages.select(
        F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"),
        tokens_of(url).alias("tokens"),
    )
    fits = matches(parsed.select("tokens").distinct(), mined)
    best = F.max(F.struct("r_sure", "r_tokens"))
    hits = fits.groupBy(F.col("tokens").alias("_tokens")).agg(best.alias("_best"))
    name, verdict = listed(F.col("host"), F.col("path"), rules)
    out = parsed.join(hits, F.col("tokens") == F.col("_tokens"), "left")
    method = F.when(F.col("_best").isNotNull(), "block").otherwise("allow")
    return out.select(
        "page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, method).alias("verdict"),
        F.array_join("_best.r_tokens", " ").alias("mined_rule"), F.col("_best.r_sure").alias("mined_confidence"),
    )


def op13_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's address."""
    pages = table(spark, sf_dir, "pages")
    return judge(pages, mine(transactions(pages, table(spark, sf_dir, "labels"))))
