"""URL filters: host and path rules, and association rules mined from labelled URLs.

Every host label, path part, query key and query value of a URL is a token. Spark's FP-growth finds the combinations of
frequent tokens in blocked URLs; they are counted over all labelled URLs, and rules pruned by support and confidence are
kept in an inverted index under their rarest token. A URL is compared only with rules posted under one of its own tokens.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Tokens of a rule at most. It bounds rules, not the URL that is read.
MAX_RULE = 3
# Tokens of a URL that go into a basket together: with three groups a basket has at most 2**9 combinations.
WIDTH = 3


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, NULLs if none fits. ``rules``: (``host/path``, verdict).

    A rule fits its host and all subdomains where the URL's path starts with the rule's path.
    """
    rule = verdict = F.lit(None).cast("string")
    for text, decision in sorted(rules, key=lambda r: len(r[0])):  # the longest is tried first, as the outermost
        name, slash, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + rest))
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Sorted distinct tokens of a URL: scheme, host, last two labels, each label of the host, each path part, file
    ending, each query key, each query pair, fragment. A NULL URL has none."""
    plain = F.coalesce(url, F.lit(""))
    tagged = lambda tag, items: F.transform(F.filter(items, lambda x: x != ""), lambda x: F.concat(F.lit(f"{tag}="), x))
    pairs = F.split(F.regexp_extract(plain, r"(?s)^[^?#]*\?([^#]*)", 1), "&")
    single = {
        "scheme": F.lower(F.regexp_extract(plain, r"(?s)^(.*?)://", 1)), "host": host, "domain": F.substring_index(host, ".", -2),
        "ending": F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1)), "fragment": F.regexp_extract(plain, r"(?s)#(.*)$", 1),
    }
    several = {
        "label": F.split(host, r"\."), "part": F.split(path, "/"), "key": F.transform(pairs, lambda x: F.substring_index(x, "=", 1)),
        "pair": F.filter(pairs, lambda x: F.contains(x, F.lit("="))),
    }
    found = [tagged(tag, F.array(c)) for tag, c in single.items()] + [tagged(tag, c) for tag, c in several.items()]
    return F.array_sort(F.array_distinct(F.concat(*found)))


def _restricted(sets: DataFrame, known: DataFrame) -> DataFrame:
    """``_id`` and those of its ``tokens`` that are in ``known``, for the ids that have any."""
    each = sets.select("_id", F.explode("tokens").alias("token")).join(known.select("token"), "token")
    return each.groupBy("_id").agg(F.array_sort(F.collect_list("token")).alias("tokens"))


def _baskets(sets: DataFrame, max_rule: int) -> DataFrame:
    """``items``: unions of ``max_rule`` groups of ``WIDTH`` tokens, so that each combination of up to that many tokens
    lies in at least one basket of its URL. URLs with no more groups have one basket."""
    out = sets.withColumn("_groups", F.ceil(F.size("tokens") / WIDTH).cast("int"))
    for i in range(max_rule):
        first = F.lit(0) if i == 0 else F.col(f"_g{i - 1}") + 1
        out = out.withColumn(f"_g{i}", F.explode(F.sequence(first, F.greatest(first, F.col("_groups") - max_rule + i))))
    return out.select(F.concat(*[F.slice("tokens", F.col(f"_g{i}") * WIDTH + 1, WIDTH) for i in range(max_rule)]).alias("items"))


def mine_rules(baskets: DataFrame, min_support: float = 0.005, min_confidence: float = 0.8, min_lift: float = 1.0,
               max_rule: int = MAX_RULE) -> DataFrame:
    """Rules ``antecedent -> block`` of at most ``max_rule`` tokens from ``tokens, blocked``: ``antecedent, token,
    confidence, support``.

    ``token`` is the rarest token of the antecedent (ties: the smallest), under which the rule is posted. Tokens below
    the support cannot be in a rule and are counted out first. FP-growth runs over the blocked rows; a URL of many
    frequent tokens gives several baskets, so its combinations are candidates, and every candidate is counted over all
    rows. No rows, no rules. Writes its rows when it is called.
    """
    rows = baskets.select(F.monotonically_increasing_id().alias("_id"), "tokens", "blocked")
    rows = materialize(rows, "baskets")
    total, bad = rows.agg(F.count("*"), F.coalesce(F.count_if("blocked"), F.lit(0))).first()
    least = min_support * total
    counted = rows.select("blocked", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("freq"), F.count_if("blocked").alias("_bad"))
    frequent = materialize(counted.where(F.col("_bad") / max(total, 1) >= min_support).select("token", "freq"), "frequent")
    each = rows.select("_id", "blocked").join(_restricted(rows, frequent), "_id").select("tokens", "blocked")
    each = materialize(each, "frequent")
    sets = each.groupBy("tokens").agg(F.count("*").alias("_all"), F.count_if("blocked").alias("_bad"))

    mined = materialize(_baskets(each.where("blocked"), max_rule), "mined")
    # A share of the baskets that is the same number of rows; the margin keeps the border case, which is counted below.
    share = min(1.0, least / max(mined.count(), 1) * (1 - 1e-9))
    items = FPGrowth(itemsCol="items", minSupport=share, minConfidence=1.0).fit(mined).freqItemsets
    candidates = items.where(F.size("items") <= max_rule).select(F.array_sort("items").alias("antecedent"))

    single = candidates.select("antecedent", F.explode("antecedent").alias("token")).join(frequent, "token")
    posted = materialize(single.groupBy("antecedent").agg(F.min_by("token", F.struct("freq", "token")).alias("token")), "candidates")
    met = sets.select("tokens", "_all", "_bad", F.explode("tokens").alias("token")).join(posted, "token")
    sums = met.where(F.size(F.array_except("antecedent", "tokens")) == 0).groupBy("antecedent", "token").agg(F.sum("_all").alias("_all"), F.sum("_bad").alias("_bad"))
    rules = sums.select("antecedent", "token", (F.col("_bad") / F.col("_all")).alias("confidence"), (F.col("_bad") / max(total, 1)).alias("support"))
    lifted = F.col("confidence") / (bad / max(total, 1) or 1.0) > min_lift
    return rules.where((F.col("support") >= min_support) & (F.col("confidence") >= min_confidence) & lifted)


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``tokens`` sets that fit a rule, with ``confidence`` and ``antecedent`` of their best one. No rules, no rows.

    Each distinct set is matched once, over the inverted index.
    """
    sets = urls.select("tokens").distinct()
    met = sets.select("tokens", F.explode("tokens").alias("token")).join(rules, "token")
    fits = F.size(F.array_except("antecedent", "tokens")) == 0
    best = F.max(F.struct("confidence", "support", "antecedent")).alias("best")
    return met.where(fits).groupBy("tokens").agg(best).select("tokens", "best.confidence", "best.antecedent")


def filter_urls(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]], url: str = "url", key: str = "page_id",
                min_support: float = 0.005, min_confidence: float = 0.8) -> DataFrame:
    """``key, host, path, rule, verdict, confidence, antecedent`` for every row of ``pages``.

    A fitting host rule decides; else an association rule blocks, and whatever no rule blocks is allowed. ``labels`` has
    ``key`` and boolean ``blocked``; several labels of one key count as blocked if any is. NULL keys are never labelled.
    Repeated rows are each returned; a NULL URL has empty host and path and is allowed.
    """
    rows = pages.select(F.col(key), F.col(url).alias("_url"))
    distinct = rows.where(F.col("_url").isNotNull()).select("_url").distinct().select(F.monotonically_increasing_id().alias("_id"), "_url")
    distinct = materialize(distinct, "urls")
    of_url = url_tokens(F.col("_url"), url_host(F.col("_url")), url_path(F.col("_url")))
    known = labels.where(F.col("blocked").isNotNull()).groupBy(key).agg(F.max("blocked").alias("blocked"))
    learned_from = rows.join(known, key).select(F.coalesce(of_url, F.array().cast("array<string>")).alias("tokens"), "blocked")
    mined = materialize(mine_rules(learned_from, min_support, min_confidence), "rules")

    used = mined.select(F.explode("antecedent").alias("token")).distinct()
    sets = _restricted(distinct.select("_id", of_url.alias("tokens")), used)
    matched = sets.join(match_rules(sets, mined), "tokens").select("_id", "confidence", "antecedent")
    matched = distinct.join(matched, "_id").select("_url", "confidence", "antecedent")
    out = rows.join(matched, "_url", "left").withColumns({"host": url_host(F.col("_url")), "path": url_path(F.col("_url"))})
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    learned = F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return out.select(key, "host", "path", rule.alias("rule"), F.coalesce(verdict, learned).alias("verdict"), "confidence", "antecedent")
