"""Soft-membership mixing: document rates whose expected domain token totals match targets.

Domains are the classes of the labelled table. A naive Bayes classifier, fitted and calibrated on a
bounded hash sample of labelled documents, gives every document a posterior over the domains. Its
features are the words with the largest class contrast and the document's shape (shares of
capitals, of marks, and of distinct words, in bins). Rates r minimise

    sum over domains ((expected tokens - target) / total)^2 + ridge * mean over tokens (r - 1)^2,  r >= 0

by projected gradient, first over cells of like posteriors, then over the documents themselves. The driver holds one multiplier per domain, and a document's
rate is a function of its posterior and these, so nothing but sums moves. Everything on rows is DataFrame functions.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.llm.literals import literal_table
from loomdex.runtime import stash

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Steps of the posteriors' grid.
GRID = 32
#: Shares of the expected tokens that each domain shall have.
TARGETS = {"q1t0": 0.80, "q1t1": 0.15, "q0t0": 0.04, "q0t1": 0.01}


def with_features(documents: DataFrame) -> DataFrame:
    """``documents`` with n_tokens and __bag: distinct words in lower case, and shape words that start with a blank.

    Each step is a projection of its own, so that no step is evaluated twice; no lambdas here.
    """
    t = F.coalesce(F.col("text"), F.lit(""))

    def share(chars: str) -> Column:
        return (F.length(t) - F.length(F.translate(t, chars, ""))) / F.col("__n")

    def bin_(name: str, x: Column, edges: list[float]) -> Column:
        return F.concat(F.lit(f" {name}"), sum((F.when(x > e, 1).otherwise(0) for e in edges), F.lit(0)).cast("string"))

    out = documents.withColumns({"__n": F.greatest(F.length(t), F.lit(1)), "__w": F.array_remove(F.split(F.lower(t), r"\s+"), "")})
    out = out.withColumns({"__d": F.array_distinct("__w"), "n_tokens": F.size("__w").cast("long"), "__c": share(UPPER), "__m": share(MARKS)})
    out = out.withColumns({"__u": F.size("__d") / F.greatest("n_tokens", F.lit(1)), "__z": F.log2(F.col("n_tokens") + F.lit(1.0))})
    shape = F.array(
        bin_("capitals", F.col("__c"), [0.05, 0.15, 0.4]),
        bin_("marks", F.col("__m"), [0.02, 0.05, 0.1, 0.2]),
        # long texts repeat words anyway, so the two go together
        F.concat(bin_("distinct", F.col("__u"), [0.05, 0.15, 0.3, 0.45, 0.6]), bin_("size", F.col("__z"), [3.0, 5.0, 7.0, 9.0])),
    )
    return out.withColumn("__bag", F.concat("__d", shape)).drop("__n", "__w", "__d", "__c", "__m", "__u", "__z")


def domain_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, domain): one row per labelled document; contradictory labels count as the worse one."""
    return (
        labels.where("doc_id is not null and quality is not null and toxic is not null")
        .groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
        .select("doc_id", F.concat(F.lit("q"), F.col("q"), F.lit("t"), F.col("t")).alias("domain"))
    )


def labelled_bags(documents: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(domain, __bag) of about ``sample`` labelled documents at most, a hash sample of the ids drawn from all; stashed."""
    known = domain_labels(labels)
    part = min(1.0, sample / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 20)) < int(part * (1 << 20)))
    chosen = stash(chosen, "labelled")
    # at most about ``sample`` ids
    return stash(with_features(documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")).select("domain", "__bag"), "bags")


def fit(bags: DataFrame, top: int) -> tuple[dict[str, float], dict[str, dict[str, float]]]:
    """(log prior by domain, log lift of a present feature by domain), for ``top`` features of (domain, __bag).

    Absent features say nothing: common words of one language must not speak against another.
    """
    spark = bags.sparkSession
    per = stash(bags.select("domain", F.explode("__bag").alias("f")).groupBy("domain", "f").agg(F.count("*").alias("c")), "features")
    # every document has one word for its marks
    docs = {r[0]: r[1] for r in per.where(F.col("f").startswith(" marks")).groupBy("domain").agg(F.sum("c")).collect()}
    if not docs:
        return {}, {}
    total = sum(docs.values())
    sizes = literal_table(spark, list(docs.items()), domain="string", docs="long")
    # contrast: how far the share of a domain's documents with the feature is from that of all others
    rates = per.join(F.broadcast(sizes), "domain")
    everywhere = per.groupBy("f").agg(F.sum("c").alias("all"))
    score = F.abs(F.col("c") / F.col("docs") - (F.col("all") - F.col("c")) / F.greatest(F.lit(total) - F.col("docs"), F.lit(1)))
    spread = rates.join(everywhere, "f").groupBy("f").agg(F.max(score * F.sqrt(F.least("docs", F.lit(400)))).alias("s"))
    best = [r[0] for r in spread.orderBy(F.desc("s"), "f").limit(top).collect()]
    shape = per.where(F.col("f").startswith(" ")).select("f").distinct()
    best = sorted({*best, *[r[0] for r in shape.collect()]})  # ``top`` features and the few shape words
    seen = {(r["domain"], r["f"]): r["c"] for r in per.where(F.col("f").isin(best)).collect()}
    base = {d: math.log(m / total) for d, m in docs.items()}
    present: dict[str, dict[str, float]] = {f: {} for f in best}
    for f in best:
        everyone = (sum(seen.get((d, f), 0) for d in docs) + 1.0) / (total + 2.0)
        for d, m in docs.items():
            present[f][d] = math.log((seen.get((d, f), 0) + everyone) / (m + 1.0)) - math.log(everyone)
    return base, present


def calibrated(
    bags: DataFrame, base: dict[str, float], present: dict[str, dict[str, float]], rounds: int = 50
) -> tuple[dict[str, float], dict[str, dict[str, float]]]:
    """``base`` and ``present`` with all evidence scaled by one factor and the domains shifted, so that the labels are likeliest.

    Features that go together make naive Bayes too sure. Afterwards the sample's mean posterior of a domain is the domain's share.
    Newton steps over the posteriors of the sample, on the driver.
    """
    if not base:
        return base, present
    domains = sorted(base)
    rows = scored(bags, base, present, domains).select("domain", "post").collect()  # the bounded sample
    z = np.log(np.maximum(np.array([r["post"] for r in rows]), 1e-300))
    y = np.array([[r["domain"] == d for d in domains] for r in rows], float)
    n, k = z.shape
    at = np.concatenate([np.zeros(k), [1.0]])  # shifts, factor

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        s = z * x[k] + x[:k]
        s -= s.max(axis=1, keepdims=True)
        p = np.exp(s)
        p /= p.sum(axis=1, keepdims=True)
        return float(-(y * np.log(np.maximum(p, 1e-300))).sum() / n), p

    value, p = loss(at)
    for _ in range(rounds):
        slope = np.concatenate([(p - y).mean(axis=0), [((p - y) * z).sum() / n]])
        mixed = (p * z) - p * (p * z).sum(axis=1, keepdims=True)
        curve = np.empty((k + 1, k + 1))
        curve[:k, :k] = np.diag(p.mean(axis=0)) - p.T @ p / n
        curve[k, :k] = curve[:k, k] = mixed.mean(axis=0)
        curve[k, k] = (mixed * z).sum() / n
        move, share = np.linalg.solve(curve + 1e-9 * np.eye(k + 1), slope), 1.0
        while share > 1e-6 and (got := loss(at - share * move))[0] > value:
            share /= 2
        if share <= 1e-6 or value - got[0] < 1e-12:
            break
        at = at - share * move
        value, p = got
    factor = float(at[k])
    return {d: factor * base[d] + float(at[i]) for i, d in enumerate(domains)}, {f: {d: factor * x for d, x in w.items()} for f, w in present.items()}


def posteriors(documents: DataFrame, base: dict[str, float], present: dict[str, dict[str, float]], domains: list[str]) -> DataFrame:
    """``documents`` with n_tokens and post, an array in the order of ``domains``."""
    return scored(with_features(documents), base, present, domains).drop("__bag")


def scored(bagged: DataFrame, base: dict[str, float], present: dict[str, dict[str, float]], domains: list[str]) -> DataFrame:
    """``bagged`` with post."""
    if not base:
        return bagged.withColumn("post", F.array(*[F.lit(1.0 / len(domains))] * len(domains)))
    names = F.array(*[F.lit(f) for f in present])
    weights = F.create_map(*[x for f, w in present.items() for x in (F.lit(f), F.array(*[F.lit(w[d]) if d in w else F.lit(0.0) for d in domains]))])
    start = F.array(*[F.lit(base[d]) if d in base else F.lit(-1e9) for d in domains])
    hit = F.array_intersect("__bag", names)
    log = F.aggregate(hit, start, lambda acc, f: F.zip_with(acc, F.element_at(weights, f), lambda a, b: a + b))
    out = bagged.withColumn("__log", log)
    lifted = F.transform("__log", lambda x: F.exp(x - F.array_max("__log")))
    out = out.withColumn("__e", lifted)
    return out.withColumn("post", F.transform("__e", lambda x: x / F.aggregate("__e", F.lit(0.0), lambda a, b: a + b))).drop("__log", "__e")


def cells_of(soft: DataFrame, width: int) -> DataFrame:
    """(cell, tokens, rows, s0, ...): rows of like posterior (to 1/GRID) together, with their tokens and posterior sums.

    Cells only find a start for the solver, which ends on the rows themselves.
    """
    w = F.greatest(F.col("n_tokens"), F.lit(0)).cast("double")
    return soft.select("cell", "n_tokens", "post").groupBy("cell").agg(
        F.sum(w).alias("tokens"), F.sum(F.lit(1.0)).alias("rows"), *[F.sum(w * F.col("post")[i]).alias(f"s{i}") for i in range(width)]
    )


def solve(cells: DataFrame, targets: list[float], steps: int, ridge: float) -> list[float]:
    """``descend`` over cells (tokens, s0, ...)."""
    post = F.array(*[F.coalesce(F.try_divide(F.col(f"s{i}"), F.col("tokens")), F.lit(0.0)) for i in range(len(targets))])
    return descend(stash(cells.select("tokens", post.alias("post")), "cells"), targets, steps, ridge)


def descend(table: DataFrame, targets: list[float], steps: int, ridge: float, start: list[float] | None = None) -> list[float]:
    """The multipliers whose ``rate_of`` a posterior minimises the objective over (tokens, post).

    The objective's gradient lies in the span of the posteriors and of r - 1, so from r = 1 on every iterate is
    the projection of 1 minus a combination of posteriors. A step moves that combination along the gradient, scaled by
    the inverse Gram matrix of the rows that aren't at zero, halved until the convex dual falls. One
    distributed aggregation a step; 1 + d + d * d sums are all that reaches the driver.
    """
    d = len(targets)
    total = table.agg(F.sum("tokens")).first()[0] or 0.0
    if total <= 0:
        return [0.0] * d
    goal = np.array(targets)

    def sums(lam: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        at = table.select("tokens", "post", rate_of(F.col("post"), lam.tolist()).alias("r"))
        free = F.when(F.col("r") > 0, F.col("tokens")).otherwise(F.lit(0.0))
        p = [F.col("post")[i] for i in range(d)]
        r = at.agg(
            F.sum(F.col("tokens") * F.col("r") * F.col("r")), *[F.sum(F.col("tokens") * F.col("r") * p[i]) for i in range(d)],
            *[F.sum(free * p[i] * p[j]) for i in range(d) for j in range(d)],
        ).first()
        x = np.array(r, float) / total
        slope = ridge * lam - (x[1 : 1 + d] - goal)
        return ridge / 2 * lam @ lam + x[0] / 2 + goal @ lam, slope, x[1 + d :].reshape(d, d) + ridge * np.eye(d)

    lam = np.zeros(d) if start is None else np.array(start)
    value, slope, curve = sums(lam)
    for _ in range(steps):
        if np.abs(slope).max() < 1e-6:
            break
        move, share = np.linalg.solve(curve, slope), 1.0
        while share > 1e-4:
            there = lam - share * move
            got = sums(there)
            if got[0] <= value - 1e-4 * share * float(slope @ move):
                break
            share /= 2
        else:
            break
        lam, (value, slope, curve) = there, got
    return lam.tolist()


def rate_of(post: Column, lam: list[float]) -> Column:
    """max(0, 1 - lam . post)."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - sum((F.lit(x) * post[i] for i, x in enumerate(lam)), F.lit(0.0)))


def mix(
    documents: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, budget: float = 1.0,
    sample: int = 6000, top: int = 96, steps: int = 40, ridge: float = 1e-4, keep_text: bool = True,
) -> DataFrame:
    """``documents`` with n_tokens, post, rate and copies.

    ``targets`` are shares, scaled to ``budget`` times all tokens. copies is floor(rate) plus one with
    the probability of the fraction, decided by a hash of doc_id and text. Null and empty texts have no tokens and
    get the rate of their posterior. Labelled classes outside ``targets`` get target 0. Without labels all
    posteriors are equal. An empty table gives an empty result. Texts are read and scored once and the scores written once,
    with the texts only if ``keep_text``.
    """
    bags = labelled_bags(documents, labels, sample)
    base, present = calibrated(bags, *fit(bags, top))
    domains = sorted({*targets, *base})
    whole = sum(targets.values()) or 1.0
    goal = [budget * targets.get(d, 0.0) / whole for d in domains]
    key = F.transform("post", lambda x: F.round(x * GRID).cast("int"))
    soft = posteriors(documents, base, present, domains)
    soft = soft.withColumns({"cell": key, "__u": F.pmod(F.xxhash64(F.lit(23), "doc_id", "text"), F.lit(1 << 24)) / F.lit(float(1 << 24))})
    soft = stash(soft if keep_text else soft.drop("text"), "posteriors")
    rows = soft.select(F.greatest("n_tokens", F.lit(0)).cast("double").alias("tokens"), "post")
    lam = descend(rows, goal, steps, ridge, solve(cells_of(soft, len(domains)), goal, steps, ridge))
    out = soft.drop("cell").withColumn("rate", rate_of(F.col("post"), lam))
    more = F.when(F.col("__u") < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return out.withColumn("copies", (F.floor("rate") + more).cast("int")).drop("__u")


def rates(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, n_tokens, domain posteriors by name, rate, copies for every document."""
    targets = options.get("targets", TARGETS)
    out = mix(documents.select("doc_id", "text"), labels, keep_text=False, **options)
    names = sorted(targets)
    return out.select("doc_id", "n_tokens", *[F.col("post")[i].alias(f"p_{d}") for i, d in enumerate(names)], "rate", "copies")


def resample(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Each document ``copies`` times; the columns are those of ``documents``."""
    columns = documents.columns
    named = documents.select(*[F.col(f"`{c}`").alias(f"__c{i}" if c not in ("doc_id", "text") else c) for i, c in enumerate(columns)])
    out = mix(named, labels, **options).withColumn("__i", F.explode(F.array_repeat(F.lit(1), F.col("copies"))))
    return out.select(*[F.col(f"__c{i}" if c not in ("doc_id", "text") else c).alias(c) for i, c in enumerate(columns)])
