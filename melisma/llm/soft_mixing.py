"""Soft-membership mixing, in DataFrame expressions only.

A naive Bayes classifier, learned from the labelled table, gives every document a posterior over domains. Nonnegative rates of
the documents are then fitted by projected gradient descent so that each domain's expected tokens, Σ rate · tokens · posterior,
match its target.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

#: Domains as conditions on a row of labels, the first that holds counts, and their shares of the mix.
DOMAINS = {"toxic": "toxic = 1", "low": "quality = 0", "good": "quality = 1"}
TARGETS = {"toxic": 0.02, "low": 0.08, "good": 0.9}
BUCKETS = 1 << 16
#: At most so many labelled rows (those with the smallest hashes of doc_id) teach the classifier.
MAX_LABELLED = 20_000
#: Pseudo-tokens that each domain gets for a bucket on average, dealt out as the buckets stand in all domains.
SMOOTHING = 20.0
STEPS = 60
STEP_SIZE = 0.9
TOLERANCE = 1e-6


def _words(docs: DataFrame, *keep: Column | str) -> DataFrame:
    """A row for each word of each text, with its bucket; a text without words has one row without a bucket."""
    parts = F.filter(F.split(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    word = docs.select(*keep, F.explode_outer(parts).alias("word"))
    return word.withColumn("bucket", F.when(F.col("word").isNotNull(), F.pmod(F.xxhash64("word"), F.lit(BUCKETS)))).drop("word")


def classifier(docs: DataFrame, labels: DataFrame, domains: Mapping[str, str] = DOMAINS, max_labelled: int = MAX_LABELLED) -> tuple[DataFrame, dict[str, float]]:
    """Log-likelihoods of each bucket (columns l_<domain>) and the log prior of each domain.

    Labels whose conditions are null or without a doc_id teach nothing; of several labels for one doc_id the least domain name counts.
    """
    domain = F.lit(None).cast("string")
    for name, condition in reversed(list(domains.items())):
        domain = F.when(F.expr(condition), F.lit(name)).otherwise(domain)
    known = labels.select("doc_id", domain.alias("domain")).filter("doc_id IS NOT NULL AND domain IS NOT NULL").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    chosen = durable(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled))
    count = {r["domain"]: r["n"] for r in chosen.groupBy("domain").agg(F.count("*").alias("n")).collect()}  # a row for each domain
    total = sum(count.values())
    prior = {d: (count.get(d, 0) + 1) / (total + len(domains)) for d in domains}
    seen = _words(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "domain")  # bounded by max_labelled
    counts = seen.filter("bucket IS NOT NULL").groupBy("bucket").agg(*(F.count(F.when(F.col("domain") == d, 1)).alias(f"c_{d}") for d in domains))
    counts = durable(counts)  # at most BUCKETS rows
    sums = counts.agg(*(F.coalesce(F.sum(f"c_{d}"), F.lit(0)).alias(d) for d in domains)).first().asDict()
    everything = max(1, sum(sums.values()))
    share = sum((F.col(f"c_{d}") for d in domains), F.lit(0.0)) / everything
    pseudo = SMOOTHING * BUCKETS
    table = counts.select("bucket", *(F.log((F.col(f"c_{d}") + pseudo * share) / (sums[d] + pseudo)).alias(f"l_{d}") for d in domains))
    return durable(table), {d: float(p) for d, p in prior.items()}


def posteriors(docs: DataFrame, labels: DataFrame, domains: Mapping[str, str] = DOMAINS, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, n_tokens and p_<domain> (they sum to 1) for every row of docs. Texts without words have the priors."""
    table, prior = classifier(docs, labels, domains, max_labelled)
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    words = _words(numbered, "row", "doc_id")
    scored = words.join(F.broadcast(table), "bucket", "left")  # at most BUCKETS rows
    sums = scored.groupBy("row", "doc_id").agg(F.count("bucket").alias("n_tokens"), *(F.coalesce(F.sum(f"l_{d}"), F.lit(0.0)).alias(f"l_{d}") for d in domains))
    logs = {d: F.col(f"l_{d}") + F.log(F.lit(prior[d])) for d in domains}
    top = F.greatest(*logs.values()) if len(logs) > 1 else next(iter(logs.values()))
    part = {d: F.exp(x - top) for d, x in logs.items()}
    whole = sum(part.values(), F.lit(0.0))
    return sums.select("doc_id", "n_tokens", *((p / whole).alias(f"p_{d}") for d, p in part.items()))


def fit_rates(members: DataFrame, targets: Mapping[str, float] = TARGETS, tokens: float | None = None, steps: int = STEPS) -> DataFrame:
    """members(doc_id, n_tokens, p_<domain>...) with a nonnegative rate for each row.

    Least squares of Σ_d (A_d - T_d)² / N_d, A_d being the rates' expected tokens, N_d those at rate 1 and T_d the target: its
    share of `tokens`, or of all tokens. Each step moves a rate against the gradient (in the metric of the documents' tokens) and
    projects it onto the nonnegative numbers; only the domains' totals come to the driver. It ends when all totals are within
    TOLERANCE of their targets or after `steps`.
    """
    names = list(targets)
    memberships = F.array(*(F.col(f"p_{d}") for d in names))

    def pull(force: list[float]) -> Column:
        """Σ force · membership. The forces are one array, so that every step compiles to the same code."""
        return F.aggregate(F.zip_with(memberships, F.array(*map(F.lit, force)), lambda p, f: p * f), F.lit(0.0), lambda a, x: a + x)

    expected = lambda rate: [F.coalesce(F.sum(rate * F.col("n_tokens") * F.col(f"p_{d}")), F.lit(0.0)).alias(d) for d in names]
    now = durable(members.withColumn("rate", F.lit(1.0)))
    have = now.agg(*expected(F.col("rate"))).first().asDict()
    whole = sum(have.values())
    share = sum(targets.values()) or 1.0
    aim = {d: targets[d] / share * (whole if tokens is None else tokens) for d in names}
    rate, totals = F.col("rate"), have
    for step in range(1, steps + 1):
        force = {d: (totals[d] - aim[d]) / have[d] if have[d] > 0 else 0.0 for d in names}
        if all(abs(totals[d] - aim[d]) <= TOLERANCE * max(1.0, whole) for d in names):
            break
        rate = F.greatest(F.lit(0.0), rate - pull([STEP_SIZE * force[d] for d in names]))
        if step % 8 == 0:
            now, rate = durable(now.withColumn("rate", rate)), F.col("rate")
        totals = now.agg(*expected(rate)).first().asDict()
    return now.withColumn("rate", rate)


def mix(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS, domains: Mapping[str, str] = DOMAINS, tokens: float | None = None, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, n_tokens, p_<domain> for each domain, and rate: how often a document enters the mix on average.

    Every row of docs gets a rate, repeated rows each their own; null and empty texts have no tokens, the prior memberships and a
    rate like any other; without labels all memberships are equal; an empty table gives an empty result; further columns are dropped.
    """
    return fit_rates(posteriors(docs, labels, domains, max_labelled), targets, tokens)
