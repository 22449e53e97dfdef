"""URL filters: fixed host and path rules, and association rules mined from labels.

FP-growth finds combinations of URL tokens that imply a block label (where labelled URLs are
long, a search by levels finds the least of them); rules are pruned by support and confidence and filed in an inverted index under their rarest token, to which
a URL's tokens are joined. Work is done per distinct URL.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path): the longest that fits decides.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
MIN_SUPPORT, MIN_CONFIDENCE = 0.002, 0.8
#: Labelled pages that a rule rests on at least, whatever their number.
MIN_PAGES = 5
#: Items of a labelled URL up to which FP-growth, which makes all subsets, mines them; with a longer URL among them the search by levels does.
LONGEST = 16
_BLOCK = "#block"
_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def parts(url: str = "url"):
    """(host, path) columns; both empty for a null url or one without ``://``."""
    u = F.coalesce(F.col(url), F.lit(""))
    has = F.instr(u, "://") > 0
    pick = lambda i: F.when(has, F.regexp_extract(u, _SPLIT, i)).otherwise(F.lit(""))
    return F.translate(pick(1), UPPER, LOWER), pick(2)


def tokens(host, path):
    """Distinct tokens: host labels and the words of the path (digits as one token)."""
    h = F.filter(F.split(host, r"\."), lambda x: x != "")
    p = F.filter(F.split(F.translate(path, UPPER, LOWER), r"[/._~=&%+-]+"), lambda x: x != "")
    words = F.concat(
        F.transform(h, lambda x: F.concat(F.lit("h:"), x)),
        F.transform(p, lambda x: F.when(x.rlike("^[0-9]+$"), F.lit("p:0")).otherwise(F.concat(F.lit("p:"), x))),
    )
    return F.array_distinct(words)


def _least_sets(seen: DataFrame, least: int, min_confidence: float) -> DataFrame:
    """need: sets of items that imply a block, so that each other such set holds one of them.

    ``seen``: t, block, items (sorted). Sets grow by an item at a time. A set that is a rule
    grows no further, as what holds it is blocked anyway; nor does one whose last item shuts
    out no page that is allowed, as without that item it has the same such pages and no fewer blocked ones.
    """
    grown = seen.select("t", "block", "items", F.array().cast("array<string>").alias("need"), F.lit(0).alias("j"), F.lit(None).cast("long").alias("g"))
    found = []
    while True:
        rest = F.slice("items", F.col("j") + 1, F.greatest(F.lit(0), F.size("items") - F.col("j")))
        grown = grown.select("t", "block", "items", "need", "g", F.col("j").alias("j0"), F.posexplode(rest).alias("k", "item"))
        grown = grown.select("t", "block", "items", F.col("g").alias("g0"), F.concat("need", F.array("item")).alias("need"), (F.col("j0") + F.col("k") + 1).alias("j"))
        grown = materialize(grown, "url-grown")
        sets = grown.groupBy("need").agg(F.count_if("block").alias("b"), F.count_if(~F.col("block")).alias("g"), F.first("g0").alias("g0")).where(F.col("b") >= least)
        sets = materialize(sets.withColumn("rule", F.col("b") / (F.col("b") + F.col("g")) >= min_confidence), "url-sets")
        found.append(sets.where("rule").select("need"))
        live = sets.where("not rule and (g0 is null or g < g0)").select("need", "g")
        if not live.limit(1).count():
            break
        grown = grown.drop("g0").join(live, "need").select("t", "block", "items", "need", "j", "g")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def mine(urls: DataFrame, labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_pages: int = MIN_PAGES, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """((key, need): item sets that imply a block, each under its rarest item; (tok, item): the tokens that are items).

    ``labelled``: u, block, one row per labelled page, all of them; ``urls``: u, toks. No labels: no rules.

    Tokens of fewer blocked pages than a rule needs are in none and are left out; tokens that
    stand in the same labelled pages are one item. An item that is a rule by itself is in no
    longer one. None of this changes which URLs hold a rule.
    """
    seen = materialize(labelled.join(urls, "u").select("block", "toks", F.monotonically_increasing_id().alias("t")), "url-labelled")
    n = seen.count()
    support = min(1.0, max(min_support, min_pages / max(1, n)))
    least = math.ceil(support * n)
    each = seen.select("t", "block", F.explode("toks").alias("tok"))
    stats = each.groupBy("tok").agg(F.count("*").alias("n"), F.count_if("block").alias("b"), F.bit_xor(F.xxhash64("t")).alias("x"), F.bit_xor(F.xxhash64("t", F.lit(1))).alias("y"))
    stats = stats.where(F.col("b") >= max(1, least)).groupBy("n", "b", "x", "y").agg(F.min("tok").alias("item"), F.collect_list("tok").alias("toks"))
    stats = materialize(stats.select("item", "toks", "n", (F.col("b") / F.col("n") >= min_confidence).alias("rule")), "url-items")
    names = stats.select("item", F.explode("toks").alias("tok"))
    alone = stats.where("rule").select(F.array("item").alias("need"))
    items = each.join(stats.where("not rule").select("item"), F.col("tok") == F.col("item")).groupBy("t").agg(F.array_sort(F.collect_list("item")).alias("items"))
    # every labelled page counts in the support, those without an item left too
    none = F.array().cast("array<string>")
    seen = materialize(seen.select("t", "block").join(items, "t", "left").select("t", "block", F.coalesce("items", none).alias("items")), "url-transactions")
    most = seen.agg(F.max(F.size("items"))).first()[0] or 0
    needs = alone
    if most > longest:
        needs = alone.union(_least_sets(seen, least, min_confidence))
    elif most:
        marked = seen.select(F.concat("items", F.when(F.col("block"), F.array(F.lit(_BLOCK))).otherwise(none)).alias("items"))
        rules = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(marked).associationRules
        needs = alone.union(rules.where((F.size("consequent") == 1) & (F.element_at("consequent", 1) == _BLOCK)).select(F.array_sort("antecedent").alias("need")))
    needs = materialize(needs.distinct(), "url-rules")
    keyed = needs.select("need", F.explode("need").alias("item")).join(stats.select("item", "n"), "item").groupBy("need").agg(F.min(F.struct("n", "item")).alias("k"))
    return materialize(keyed.select(F.col("k.item").alias("key"), "need"), "url-index"), names


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(page_id, host, path, rule, verdict) per row of ``pages``.

    A label of quality 0 or toxic 1 for doc_id = page_id says block; other labels say
    allow. A null url has neither host nor path and is allowed. Repeated rows are judged alike.
    """
    spark = pages.sparkSession
    u = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("u"))
    host, path = parts("u")
    urls = u.select("u").distinct().withColumns({"host": host, "path": path})
    urls = materialize(urls.withColumn("toks", tokens(F.col("host"), F.col("path"))), "urls")
    marks = labels.select(F.col("doc_id").cast("long").alias("page_id"), F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.col("quality") == 0, F.col("toxic") == 1).alias("block")).where("page_id is not null and block is not null")
    marks = marks.groupBy("page_id").agg(F.max("block").alias("block"))
    index, names = mine(urls.select("u", "toks"), u.join(marks, "page_id").select("u", "block"), min_support, min_confidence)
    held = urls.select("u", F.explode("toks").alias("tok")).join(names, "tok").groupBy("u").agg(F.collect_set("item").alias("toks"))
    mined = held.select("u", "toks", F.explode("toks").alias("key")).join(index, "key").where(F.size(F.array_except("need", "toks")) == 0).select("u").distinct().withColumn("mined", F.lit(True))
    fixed = spark.createDataFrame([(h + p, h, p, v) for v, h, p in rules], "rule string, rhost string, rpath string, rverdict string")
    deep = max([h.count(".") + 1 for _, h, _ in rules], default=1)
    labels_of = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.least(F.lit(deep), F.size(labels_of))), lambda i: F.array_join(F.slice(labels_of, -i, i), "."))
    fits = urls.select("u", "path", F.explode(ends).alias("rhost")).join(fixed, "rhost").where(F.col("path").startswith(F.col("rpath")))
    best = fits.groupBy("u").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", F.col("rverdict").alias("v"))).alias("b"))
    found = urls.select("u", "host", "path").join(best, "u", "left").join(mined, "u", "left").select("u", "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.v", F.when(F.col("mined"), "block"), F.lit("allow")).alias("verdict"))
    return u.join(found, "u").select("page_id", "host", "path", "rule", "verdict")
