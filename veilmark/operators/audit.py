"""Entity-level membership audit over scored texts: token scores, evidence, false-discovery control, risk."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import significance as sig
from ..functions.patterns import impact
from .leakage import auc, tpr_at_fpr

# Fixed values.
MIN_K_SHARE, MIN_CONTROLS, MAD_SIGMA, NOT_SIGNIFICANT, MAX_FINDINGS, MIN_TYPE_ROWS = 0.2, 30, 1.4826, 3.9, 500, 10
METHODS = ["loss", "zlib", "min_k", "recall", "loss_suffix", "reference", "reference_suffix"]


def targets(records: DataFrame, types: list[str] | None = None, max_entities: int | None = None, context: int | None = None) -> DataFrame:
    """One row for each span with a value: id, pos, entity_type, start, end, prefix, value, suffix.

    context: how many characters a scorer sees on either side, so no whole text travels with each span; None: all."""
    rows = records.select("id", "text", F.posexplode("entities").alias("pos", "e")).select("id", "text", "pos", "e.*")
    if types:
        rows = rows.where(F.col("entity_type").isin(types))
    cut = lambda a, n: F.substring(F.col("text"), a, n)
    rows = rows.select("id", "pos", "entity_type", "start", "end", cut(F.lit(1), F.col("start")).alias("prefix"), cut(F.col("start") + 1, F.col("end") - F.col("start")).alias("value"), cut(F.col("end") + 1, F.length("text")).alias("suffix"))
    rows = rows.where(F.trim("value") != "")
    if context is not None:
        rows = rows.withColumn("prefix", F.right("prefix", F.lit(context))).withColumn("suffix", F.left("suffix", F.lit(context)))
    return rows.orderBy(F.xxhash64("id", "pos"), "id", "pos").limit(max_entities) if max_entities else rows


def token_parts(tokens: Column, start: Column, end: Column, window: int | None = None, text_start: Column | int = 0) -> Column:
    """struct(all, value, suffix) of log-probabilities of tokens array<struct<start, end, logprob>> around a span."""
    from_ = F.lit(text_start) if isinstance(text_start, int) else text_start
    known = F.filter(tokens, lambda t: t["logprob"].isNotNull() & ~F.isnan(t["logprob"]) & (t["end"] > from_))
    value = F.filter(known, lambda t: (t["start"] < end) & (t["end"] > start))
    suffix = F.filter(known, lambda t: (t["start"] >= end) & ~((t["start"] < end) & (t["end"] > start)))
    suffix = F.slice(suffix, 1, window) if window else suffix
    lp = lambda a: F.transform(a, lambda t: t["logprob"])
    return F.struct(lp(known).alias("all"), lp(value).alias("value"), lp(suffix).alias("suffix"))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean_loss(a: Column) -> Column:
    return _sum(a) / F.nullif(F.size(a), F.lit(0))


def min_k(a: Column, share: float = MIN_K_SHARE) -> Column:
    """Mean of the lowest share of tokens, at least one; halves round to even."""
    n = F.greatest(F.lit(1), F.bround(F.size(a) * F.lit(share)).cast("int"))
    return F.when(F.size(a) > 0, mean_loss(F.slice(F.array_sort(a), 1, n)))


def log_mean_exp(a: Column) -> Column:
    top = F.array_max(a)
    return top + F.log(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.exp(x - top)) / F.size(a))


def recall_ratio(unconditional: Column, conditional: Column) -> Column:
    return conditional / F.nullif(unconditional, F.lit(0.0))


def suffix_or_value(parts: Column) -> Column:
    return F.when(F.size(parts["suffix"]) > 0, parts["suffix"]).otherwise(parts["value"])


def reference_set(candidate: Column, references: Column) -> Column:
    """Total log-probability of the candidate tokens against the log mean probability of reference totals."""
    return F.when(F.size(references) > 0, _sum(candidate) - log_mean_exp(references))


@F.pandas_udf(T.LongType())
def zlib_bits(text: pd.Series) -> pd.Series:
    return text.map(lambda t: 8 * len(zlib.compress((t or "").encode())))


def score_texts(texts: DataFrame, score: Callable[[list[str]], list[list[tuple[int, int, float]]]], batch: int = 64) -> DataFrame:
    """texts with column tokens, by a pluggable scorer of lists of texts; equal texts are scored once."""

    def run(frames):
        for frame in frames:
            found = []
            for at in range(0, len(frame), batch):
                found += score(frame["text"].iloc[at : at + batch].tolist())
            frame["tokens"] = [[{"start": a, "end": b, "logprob": p} for a, b, p in t] for t in found]
            yield frame[["text", "tokens"]]

    unique = texts.select("text").distinct()
    scored = unique.mapInPandas(run, "text string, tokens array<struct<start:int,end:int,logprob:double>>")
    return texts.join(scored, "text")


# --- evidence -----------------------------------------------------------------------------------
def robust(df: DataFrame, value: str, *by: str) -> DataFrame:
    """by..., n, center (median), spread (1.4826 MAD, else population deviation, else 1)."""
    clean = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    centers = clean.groupBy(*by).agg(F.percentile(value, F.lit(0.5)).alias("center"), F.count("*").alias("n"), F.stddev_pop(value).alias("sd"))
    joined = clean.join(F.broadcast(centers), list(by)) if by else clean.crossJoin(F.broadcast(centers))  # a row for each entity type
    mad = joined.groupBy(*by, "center", "n", "sd").agg((F.percentile(F.abs(F.col(value) - F.col("center")), F.lit(0.5)) * MAD_SIGMA).alias("mad"))
    spread = F.when(F.col("mad") > 0, F.col("mad")).when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)
    return mad.select(*by, "n", "center", spread.alias("spread"))


def standardize(df: DataFrame, value: str, control: str, kind: str = "entity_type") -> DataFrame:
    """df with z and control_z: by type where a type has 30 controls, else pooled."""
    own = robust(df, control, kind).where(F.col("n") >= MIN_CONTROLS).select(kind, F.col("center").alias("c1"), F.col("spread").alias("s1"))
    pool = robust(df, control).select(F.col("center").alias("c0"), F.col("spread").alias("s0"))
    out = df.join(F.broadcast(own), kind, "left").crossJoin(F.broadcast(pool))  # a row for each type, and one row
    c, s = F.coalesce("c1", "c0"), F.coalesce("s1", "s0")
    return out.withColumn("z", (F.col(value) - c) / s).withColumn("control_z", (F.col(control) - c) / s).drop("c0", "s0", "c1", "s1")


@F.pandas_udf(T.DoubleType())
def normal_tail(z: pd.Series) -> pd.Series:
    """One-sided p; a missing z gives 1."""
    return z.map(lambda v: 1.0 if v is None or not math.isfinite(v) else sig.normal_sf(v))


def _grams(padded: Column, order: int) -> Column:
    """All runs of order code points of a text, in one linear pass."""
    return F.regexp_extract_all(padded, F.lit(f"(?s)(?=(.{{{order}}}))."), F.lit(1))


def _packed_counts(text: str, keep: np.ndarray, order: int) -> tuple[list[str], list[int]]:
    """The different runs of order code points of a text that start where keep is true, and their counts."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    known = np.zeros(0x110000, dtype=bool)
    known[points] = True
    alphabet = np.flatnonzero(known).astype(np.uint32)
    bits = max(1, int(len(alphabet) - 1).bit_length())
    if bits * order > 64:  # too many different characters for one number
        found = Counter(text[i : i + order] for i in np.flatnonzero(keep).tolist())
        return list(found), list(found.values())
    dense = np.zeros(0x110000, dtype=np.uint64)
    dense[alphabet] = np.arange(len(alphabet), dtype=np.uint64)
    points, n = dense[points], len(points) - order + 1
    key = points[:n].copy()
    for i in range(1, order):
        key = (key << np.uint64(bits)) | points[i : i + n]
    key, counts = np.unique(key[keep[:n]], return_counts=True)
    places = np.uint64(bits) * np.arange(order - 1, -1, -1, dtype=np.uint64)
    letters = alphabet[((key[:, None] >> places) & np.uint64((1 << bits) - 1)).astype(np.int64)]
    whole = letters.tobytes().decode("utf-32-le")
    return [whole[i : i + order] for i in range(0, len(whole), order)], counts.tolist()


def gram_counter(order: int, piece: int = 1 << 22, flush: int = 500_000):
    """(g, n): the grams of a task's texts, order - 1 blanks before each, counted over pieces of some million characters; a gram can have several rows."""
    pad = " " * (order - 1)

    def rows(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["g", "n"])

    def parts(batch):
        taken, size = [], 0
        for value in batch.column(0):
            taken.append(value.as_py())
            size += len(taken[-1]) + len(pad)
            if size > piece:
                yield taken, size
                taken, size = [], 0
        if taken:
            yield taken, size

    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            for texts, size in parts(batch):
                keep = np.ones(size + 1, dtype=bool)
                ends = np.cumsum([len(x) + len(pad) for x in texts])
                for i in range(1, order):  # runs over the end of a text
                    keep[ends - i] = False
                found, counts = _packed_counts("".join(pad + x for x in texts), keep[:size], order)
                for g, n in zip(found, counts, strict=True):
                    held[g] += n
                if len(held) > flush:
                    yield rows(held)
                    held.clear()
        if held:
            yield rows(held)

    return run


def gram_counts(records: DataFrame, order: int = 4) -> DataFrame:
    """context, next, n: how often a character follows the order - 1 before it, over the whole texts of all records (null: none)."""
    texts = records.where("text <> ''").select(F.make_valid_utf8("text").alias("text"))
    counts = texts.mapInArrow(gram_counter(order), "g string, n long").groupBy("g").agg(F.sum("n").alias("n"))
    return counts.select(F.left("g", F.lit(order - 1)).alias("context"), F.substring("g", order, 1).alias("next"), "n")


def gram_losses(rows: DataFrame, counts: DataFrame, order: int = 4, add: float = 0.1, alphabet: int = 256) -> DataFrame:
    """id, pos, variant, loss, size: the mean negative log-probability of the characters of each span, given those before
    them, and their number.

    rows have text and start, end of a span; only the span's own grams meet the counts, whatever the length of the text.
    Each different gram is looked up once. An empty span has no row.
    """
    span = F.substring(F.concat(F.lit(" " * (order - 1)), "text"), F.col("start") + 1, F.col("end") - F.col("start") + order - 1)
    own = rows.where("end > start").select("id", "pos", "variant", F.explode(_grams(span, order)).alias("g"))
    # all that follows a context in one row, no more than characters there are; so the corpus is counted once
    contexts = counts.groupBy("context").agg(F.sum("n").alias("whole"), F.map_from_entries(F.collect_list(F.struct("next", "n"))).alias("by_next"))
    wanted = own.select("g").distinct().select("g", F.left("g", F.lit(order - 1)).alias("context"), F.substring("g", order, 1).alias("next"))
    known = wanted.join(contexts, "context", "left")
    zero = F.lit(0)
    loss = -F.log((F.coalesce(F.try_element_at("by_next", "next"), zero) + add) / (F.coalesce("whole", zero) + add * alphabet))
    return own.join(known.select("g", loss.alias("l")), "g").groupBy("id", "pos", "variant").agg(F.avg("l").alias("loss"), F.count("*").alias("size"))


def evidence(losses: DataFrame, targets: DataFrame) -> DataFrame:
    """entity, entity_type, method, member, control from gram_losses of variants: by mean loss, and by the total against
    the mean probability of the references. Reference 1 is the control, judged against those after it.

    A span without a reference has no control and gives no row; with one, it has no row of the second method.
    """
    score = F.struct(F.col("variant"), (-F.col("loss")).alias("mean"), (-F.col("loss") * F.col("size")).alias("total"))
    rows = losses.groupBy("id", "pos").agg(F.array_sort(F.collect_list(score)).alias("v"))  # a value and its few references
    rows = rows.where((F.size("v") > 1) & (F.col("v")[0]["variant"] == 0) & (F.col("v")[1]["variant"] == 1))
    rest = F.transform(F.slice("v", 3, F.greatest(F.size("v") - 2, F.lit(0))), lambda x: x["total"])
    against = lambda i: F.when(F.size(rest) > 0, F.col("v")[i]["total"] - log_mean_exp(rest))
    both = F.array(
        F.struct(F.lit("loss").alias("method"), F.col("v")[0]["mean"].alias("member"), F.col("v")[1]["mean"].alias("control")),
        F.struct(F.lit("reference").alias("method"), against(0).alias("member"), against(1).alias("control")),
    )
    out = rows.select("id", "pos", F.inline(both)).where("member is not null")
    kinds = targets.select("id", "pos", "entity_type")
    return out.join(kinds, ["id", "pos"]).select(F.concat_ws("#", "id", "pos").alias("entity"), "entity_type", "method", "member", "control")


def attack_strength(scores: DataFrame) -> DataFrame:
    """One row: auc and tpr at 0.1, 1 and 5 % of rows (member, control)."""
    both = scores.select(F.col("member").alias("score"), F.lit(1).alias("member")).union(scores.select("control", F.lit(0)))
    wide = tpr_at_fpr(both).groupBy().pivot("level", [0.001, 0.01, 0.05]).agg(F.first("tpr"))
    return auc(both).crossJoin(wide)  # one row each


def best_method(scores: DataFrame, methods: list[str]) -> str:
    """The method with the largest AUC over rows (method, member, control); the first wins ties."""
    found = {m: auc_of(scores.where(F.col("method") == m)) for m in methods}
    return max(methods, key=lambda m: found[m])


def auc_of(scores: DataFrame) -> float:
    both = scores.select(F.col("member").alias("score"), F.lit(1).alias("member")).union(scores.select("control", F.lit(0)))
    return auc(both).first()["auc"] or 0.0


def gather(scores: DataFrame, methods: list[str], primary: str = "auto", folds: int = 2) -> DataFrame:
    """Cross-fitted evidence from long rows (entity, entity_type, method, member, control): each hash fold uses the
    method that is best on the others; columns entity, entity_type, method, z, control_z, p."""
    fold = F.pmod(F.xxhash64("entity"), F.lit(folds))
    out = None
    for f in range(folds):
        mine, rest = scores.where(fold == f), scores.where(fold != f)
        method = best_method(rest, methods) if primary == "auto" else primary
        part = standardize(mine.where(F.col("method") == method), "member", "control")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("p", normal_tail("z")).select("entity", "entity_type", "method", "z", "control_z", "p")


def holdout_evidence(members: DataFrame, holdout: DataFrame, value: str = "member", kind: str = "entity_type") -> DataFrame:
    """members with z and p against real entities that were never trained on."""
    own = robust(holdout, value, kind).where(F.col("n") >= MIN_CONTROLS).select(kind, F.col("center").alias("c1"), F.col("spread").alias("s1"))
    pool = robust(holdout, value).select(F.col("center").alias("c0"), F.col("spread").alias("s0"))
    out = members.join(F.broadcast(own), kind, "left").crossJoin(F.broadcast(pool))  # a row for each type, and one row
    z = (F.col(value) - F.coalesce("c1", "c0")) / F.coalesce("s1", "s0")
    return out.withColumn("z", z).drop("c0", "s0", "c1", "s1").withColumn("p", normal_tail("z"))


def benjamini_hochberg(df: DataFrame, p: str = "p", q: str = "q") -> DataFrame:
    """df with q-values: the running minimum from above of p n / rank, at most 1.

    Runs over the distinct p-values, which are few beside the rows of a large audit, in range parts.
    """
    from ..plans.running import running_totals

    ranked = running_totals(df.groupBy(p).agg(F.count("*").alias("__k")), p, {"__rank": "__k"})
    n = df.where(F.col(p).isNotNull()).count()
    raw = ranked.withColumn("__raw", F.col(p) * n / F.col("__rank")).withColumn("__part", F.floor(F.col(p) * 256))
    inside = Window.partitionBy("__part").orderBy(p).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    above = Window.orderBy("__part").rowsBetween(1, Window.unboundedFollowing)  # at most 257 rows
    floors = raw.groupBy("__part").agg(F.min("__raw").alias("__low")).select("__part", F.min("__low").over(above).alias("__above"))
    least = raw.withColumn("__in", F.min("__raw").over(inside)).join(F.broadcast(floors), "__part")
    least = least.select(p, F.least(F.lit(1.0), "__in", F.coalesce("__above", F.lit(1.0))).alias(q))
    return df.join(least, p, "left")


def severity(risk: Column) -> Column:
    return F.when(risk >= 9, "critical").when(risk >= 7, "high").when(risk >= 4, "medium").when(risk >= 0.1, "low").otherwise("info")


def entity_risk(df: DataFrame, fdr: float = 0.05, kind: str = "entity_type") -> DataFrame:
    """df(p, q, entity_type) with likelihood, risk (0 to 10) and severity; without significance at most 3.9."""
    risk = 10.0 * (1 - F.col("p")) * impact(F.col(kind))
    capped = F.round(F.when(F.col("q") > fdr, F.least(risk, F.lit(NOT_SIGNIFICANT))).otherwise(risk), 2)
    return df.withColumn("likelihood", 1 - F.col("p")).withColumn("risk", capped).withColumn("severity", severity(F.col("risk")))


def severity_counts(df: DataFrame) -> DataFrame:
    levels = df.sparkSession.sql("SELECT explode(array('critical', 'high', 'medium', 'low', 'info')) AS severity")
    return levels.join(df.groupBy("severity").agg(F.count("*").alias("n")), "severity", "left").na.fill(0, ["n"])


def top_findings(df: DataFrame, limit: int = MAX_FINDINGS) -> DataFrame:
    """The riskiest findings: a top-n report."""
    return df.orderBy(F.desc("risk"), "q", "entity").limit(limit)


def exposure(value: Column, references: Column) -> tuple[Column, Column]:
    """(rank, bits): 1 + number of references at least as likely, and log2((n + 1) / rank)."""
    rank = 1 + F.size(F.filter(references, lambda r: r >= value))
    return rank, F.log2(F.size(references) + 1) - F.log2(rank)


@F.pandas_udf(T.DoubleType())
def binomial_tail(hits: pd.Series, trials: pd.Series, rate: pd.Series) -> pd.Series:
    return pd.Series([sig.binomial_tail(int(h), int(n), float(r)) for h, n, r in zip(hits, trials, rate, strict=True)])


def probe_evidence(df: DataFrame, samples: int) -> DataFrame:
    """df(member_hits, control_hits) with p: binomial tail against the smoothed pooled control rate."""
    pool = df.agg(((F.sum("control_hits") + 1) / (F.count("*") * samples + 2)).alias("rate"))
    return df.crossJoin(F.broadcast(pool)).withColumn("p", binomial_tail("member_hits", F.lit(samples), "rate"))  # one row


def confirm(df: DataFrame, fdr: float = 0.05) -> DataFrame:
    """df(severity, risk, confirm_p) with confirmed: high and critical rows get their own correction, and those that
    fail it are at most low."""
    again = benjamini_hochberg(df.where("severity in ('high', 'critical')").select("entity", F.col("confirm_p").alias("cp")), "cp", "cq").select("entity", "cq")
    out = df.join(again, "entity", "left").withColumn("confirmed", F.col("cq") <= fdr)
    risk = F.when(~F.col("confirmed"), F.least("risk", F.lit(NOT_SIGNIFICANT))).otherwise(F.col("risk"))
    return out.withColumn("risk", risk).withColumn("severity", severity(F.col("risk"))).drop("cq")


def type_strength(scores: DataFrame, least: int = MIN_TYPE_ROWS) -> DataFrame:
    """entity_type, auc of types with enough rows (member, control): pairs are counted by ranks inside the type."""
    both = scores.select("entity_type", F.col("member").alias("score"), F.lit(1.0).alias("m")).union(scores.select("entity_type", "control", F.lit(0.0)))
    counts = both.where("score is not null").groupBy("entity_type", "score").agg(F.sum("m").alias("pos"), F.sum(1 - F.col("m")).alias("neg"))
    below = Window.partitionBy("entity_type").orderBy("score").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumn("cn", F.sum("neg").over(below))
    out = ranked.groupBy("entity_type").agg((F.sum(F.col("pos") * (F.col("cn") - F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg"))).alias("auc"), F.sum("pos").alias("rows"))
    return out.where(F.col("rows") >= least).select("entity_type", "auc")
