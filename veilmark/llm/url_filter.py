"""URL filter: association rules over URL tokens.

Listed rules (host suffix and path prefix) decide the URLs they fit, and so label them: blocked or allowed.
FP-growth over the URLs' tokens mines which token combinations go with being blocked.  A rule's confidence is the share of blocked ones
among the *labelled* URLs that have its tokens; its reach the share of listed blocked ones among *all* that have them, so a
combination that is mostly unlisted says nothing.  Rules are pruned by support, confidence, reach and by simpler
rules at least as sure.  Other URLs are matched through an inverted index, token to rules: a rule fires when all its
tokens are hit, and the surest firing rule decides.

Defined results: a null url, or one without ``://``, has empty host and path, no rule, and the default verdict
unless a mined rule fires; repeated rows each give a row; without blocked URLs no rules are mined; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The listed rules as (verdict, host, path).
LISTED = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlParams:
    #: share of URLs that a token combination must be in
    support: float = 0.01
    confidence: float = 0.9
    #: share of the URLs with a combination, labelled or not, that must be listed as blocked
    reach: float = 0.5
    #: listed blocked URLs that a rule must have
    least_rows: int = 10
    #: tokens in a rule
    longest: int = 3
    default: str = "allow"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    none = F.lit("")
    return F.coalesce(F.translate(host, _UPPER, _LOWER), none), F.coalesce(path, none)


def tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens: host suffixes, path segments with digits as one sign, query keys and the scheme."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    suffixes = F.transform(labels, lambda x, i: F.concat(F.lit("host="), F.array_join(F.slice(labels, i + 1, F.size(labels)), ".")))
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    steps = F.transform(segments, lambda x, i: F.concat(F.lit("path"), i.cast("string"), F.lit("="), F.regexp_replace(x, "[0-9]+", "#")))
    query = F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda x: x != "")
    keys = F.transform(query, lambda x: F.concat(F.lit("query="), F.regexp_extract(x, "^([^=]*)", 1)))
    words = F.transform(F.filter(F.flatten(F.transform(labels, lambda x: F.split(x, "-"))), lambda x: x != ""), lambda x: F.concat(F.lit("word="), x))
    return F.array_distinct(F.concat(suffixes, steps, keys, words))


def listed_rule(host: Column, path: Column) -> tuple[Column, Column]:
    """The longest listed rule that fits and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, suffix, prefix in sorted(LISTED, key=lambda r: len(r[1] + r[2])):
        fits = F.concat(F.lit("."), host).endswith("." + suffix) & path.startswith(prefix)
        rule, verdict = F.when(fits, F.lit(suffix + prefix)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def mine(rows: DataFrame, params: UrlParams = UrlParams()) -> list[tuple[frozenset[str], str, float, float]]:
    """(tokens, verdict, confidence, support) of the rules kept, surest first, from rows(tokens, verdict); the verdict is null where unknown."""
    p = params
    label = lambda verdict: F.concat(F.lit("label="), verdict)
    baskets = rows.select(F.array_compact(F.array_append("tokens", label(F.col("verdict")))).alias("items"))
    if baskets.isEmpty():
        return []
    model = FPGrowth(itemsCol="items", minSupport=p.support, minConfidence=p.reach).fit(baskets)
    sure = model.associationRules.where((F.col("consequent")[0] == "label=block") & (F.size("antecedent") <= p.longest))
    sure = sure.where(~F.exists("antecedent", lambda t: t.startswith("label="))).select(F.array_sort("antecedent").alias("antecedent"), "consequent", F.col("confidence").alias("reach"), "support")
    # how often the same tokens go with allow: counted over the labelled rows, as rare combinations are no frequent item sets
    total = rows.count()
    sure = sure.where(F.col("support") * total >= p.least_rows)
    needs = [r.antecedent for r in sure.select("antecedent").collect()]
    if not needs:
        return []
    every = F.array(*[F.array(*[F.lit(t) for t in need]) for need in needs])
    fits = F.filter(F.sequence(F.lit(0), F.lit(len(needs) - 1)), lambda i: F.size(F.array_except(F.get(every, i), F.col("tokens"))) == 0)
    allowed = {r.i: r["count"] for r in rows.where("verdict = 'allow'").select(F.explode(fits).alias("i")).groupBy("i").count().collect()}
    known = {tuple(need): allowed.get(i, 0) for i, need in enumerate(needs)}
    share = lambda r: r.support * total / (r.support * total + known[tuple(r.antecedent)])
    # the number of itemsets is bounded by the least support, whatever the number of URLs
    found = sorted(((frozenset(r.antecedent), r.consequent[0][len("label="):], share(r), r.support) for r in sure.collect() if share(r) >= p.confidence), key=lambda r: (-round(r[2], 9), -round(r[3], 9), len(r[0]), sorted(r[0])))
    kept: list[tuple[frozenset[str], str, float, float]] = []
    for rule in sorted(found, key=lambda r: len(r[0])):
        if not any(k[0] <= rule[0] and k[2] >= rule[2] - 1e-9 for k in kept):
            kept.append(rule)
    return sorted(kept, key=found.index)


def fired(rules: list[tuple[frozenset[str], str, float, float]], found: Column) -> Column:
    """Number (from 0, surest first) of the first rule all of whose tokens are in the array; null if none."""
    if not rules:
        return F.lit(None).cast("int")
    index: dict[str, list[int]] = {}
    for i, (need, *_) in enumerate(rules):
        for token in sorted(need):
            index.setdefault(token, []).append(i)
    lists = F.create_map(*[c for token, ids in sorted(index.items()) for c in (F.lit(token), F.array(*[F.lit(i) for i in ids]))])
    need = F.array(*[F.lit(len(r[0])) for r in rules])
    hits = F.flatten(F.transform(F.filter(found, lambda t: F.map_contains_key(lists, t)), lambda t: F.get(F.array(lists[t]), F.lit(0))))
    whole = F.filter(F.array_distinct(hits), lambda i: F.size(F.filter(hits, lambda x: x == i)) == F.get(need, i))
    return F.array_min(whole)


def judge_urls(pages: DataFrame, params: UrlParams = UrlParams()) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rule of each row of pages(page_id, url)."""
    url = F.col("url").cast("string")
    host, path = parts(url)
    rows = pages.select("page_id", url.alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = listed_rule(F.col("host"), F.col("path"))
    rows = rows.withColumn("rule", rule).withColumn("listed", verdict)
    rows = rows.withColumn("tokens", tokens(F.col("host"), F.col("path"), F.col("url")))
    rules = mine(rows.where("host <> ''").select("tokens", F.col("listed").alias("verdict")), params)
    rows = rows.withColumn("hit", F.when(F.col("listed").isNull(), fired(rules, F.col("tokens"))))
    names = F.array(*[F.lit(" & ".join(sorted(r[0]))) for r in rules]).cast("array<string>")
    verdicts = F.array(*[F.lit(r[1]) for r in rules]).cast("array<string>")
    verdict = F.coalesce("listed", F.get(verdicts, F.col("hit")), F.lit(params.default))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.get(names, F.col("hit")).alias("mined_rule"))
