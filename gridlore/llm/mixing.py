"""Mixing sources to target weights (4): soft-membership mixing.

Method, all in DataFrame functions:

1. A labelled table names a domain for some documents.  Naive Bayes over hashed words
   is counted on about ``MAX_TRAIN_ROWS`` labelled documents; its
   tables (``BUCKETS`` numbers per domain) become array literals.
2. Every document gets its domains' posteriors from all its words, tempered to
   ``TEMPER`` words so that long texts keep soft memberships, and its token count
   (words).  These few numbers per document are stored once.
3. Of all nonnegative rates r with sum_i r_i t_i p_i equal to the targets, those nearest
   to 1 are r_i = max(0, 1 - p_i . v) for one vector v, which damped Newton steps on the
   dual find, in the metric of G = sum_i t_i p_i p_i^T over documents with a rate above 0.
   A step needs one distributed sum of a few numbers per pair of domains, so nothing per
   document is stored between steps and nothing returns to the driver but those sums.

Targets are either weights of a total or preferences: the share of its own tokens that a
domain should keep (``PREFERENCES``).  The query and the pipeline use weights (``TARGETS``).
Without a budget in tokens the weights' total is the largest that the domains hold: the
scarcest domain, relative to its weight, is taken whole; single documents of mixed
membership may still be repeated to meet the weights.
``copies`` are whole numbers whose running sum follows the running sum of the rates: rows are dealt
evenly to strata of about ``STRATUM`` rows, ordered there by likeliest domain and length, and a row gets as many
copies as whole numbers lie between the sums before and after it.  So the copies' tokens meet the fitted totals
for every domain and length, not only on average.  Each row's copies are its rate rounded down or up.

Defined cases: a null or blank text has no tokens, prior posteriors, and its rate; a
document labelled twice teaches its alphabetically first domain; null labels teach
nothing; with nothing labelled every rate is 1; a domain that no document resembles
keeps a target of 0, as does one without a target; a null doc_id is carried; repeated rows
are rated alike, while their copies may differ by one; very long texts are counted whole; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, Workspace, documents, numbered

BUCKETS = 4096
MAX_TRAIN_ROWS = 4000
TEMPER = 60.0
SMOOTHING = 0.5
STEPS = 30
CLOSE = 1e-4
PREFERENCES = {"good": 1.0, "poor": 0.5}
TARGETS = {"good": 0.95, "poor": 0.04, "toxic": 0.01}
STRATUM = 50_000


def words(text: Column) -> Column:
    """Runs of characters that aren't blanks."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _bucket(word: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


def numbers(values) -> Column:
    """An array of doubles as one literal."""
    return F.split(F.lit(",".join(f"{float(v):.17g}" for v in values)), ",").cast("array<double>")


class Domains:
    """Domain names, log priors, and log weights by bucket relative to the first domain."""

    def __init__(self, names: list[str], prior: np.ndarray, weights: np.ndarray):
        self.names, self.prior, self.weights = names, prior, weights


def learn_domains(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain",
                  buckets: int = BUCKETS, max_train_rows: int = MAX_TRAIN_ROWS) -> Domains:
    """Count words by domain over a bounded sample of the labelled documents."""
    known = labelled.select(F.col(id_col).cast("long").alias("__id"), F.col(domain_col).cast("string").alias("__domain")).where(
        "__id IS NOT NULL AND __domain IS NOT NULL")
    n = known.count()
    if n > max_train_rows:
        known = known.where(F.pmod(F.xxhash64("__id", F.lit(4)), F.lit(1 << 30)) < int((1 << 30) * max_train_rows / n))
    known = F.broadcast(known.groupBy("__id").agg(F.min("__domain").alias("__domain")))  # about max_train_rows rows
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text")).join(known, "__id")
    found = rows.select("__domain", F.explode(F.concat(F.array(F.lit(-1)), F.transform(words(F.col("__text")), lambda w: _bucket(w, buckets)))).alias("b"))
    counts = found.groupBy("__domain", "b").count().collect()  # at most (buckets + 1) * domains rows
    names = sorted({r["__domain"] for r in counts})
    table, prior = np.full((len(names), buckets), SMOOTHING), np.ones(len(names))
    for r in counts:
        if r["b"] < 0:
            prior[names.index(r["__domain"])] += r["count"]
        else:
            table[names.index(r["__domain"]), r["b"]] += r["count"]
    log = np.log(table / table.sum(1, keepdims=True))
    prior = np.log(prior / prior.sum()) if names else prior
    return Domains(names, prior, log - log[:1])


def posteriors(docs: DataFrame, domains: Domains, id_col: str = "doc_id", text_col: str = "text", *further: str) -> DataFrame:
    """(doc_id, n_tokens, p, further columns): p holds one number per domain, which sum to 1."""
    buckets = domains.weights.shape[1]
    found = F.transform(words(F.col(text_col)), lambda w: _bucket(w, buckets))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), found.alias("b"), *further)
    n = F.size("b")
    cut = F.least(F.lit(1.0), F.lit(TEMPER) / F.greatest(n, F.lit(1)))

    def total(weights: np.ndarray) -> Column:
        table = numbers(weights)
        return F.aggregate("b", F.lit(0.0), lambda s, i: s + F.get(table, i)) * cut

    odds = [F.lit(0.0), *(total(w) for w in domains.weights[1:])]
    odds = [o + F.lit(float(p)) for o, p in zip(odds, domains.prior, strict=True)]
    rows = rows.select("doc_id", n.cast("long").alias("n_tokens"), F.array(*odds).alias("o"), *further)
    parts = F.transform("o", lambda x: F.exp(x - F.array_max("o")))
    rows = rows.select("doc_id", "n_tokens", parts.alias("e"), *further)
    return rows.select("doc_id", "n_tokens", F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda s, y: s + y)).alias("p"), *further)


def _rate(v: np.ndarray) -> Column:
    """max(0, 1 - p . v)"""
    dot = F.lit(0.0)
    for j, x in enumerate(v):
        dot = dot + F.get("p", F.lit(j)) * F.lit(float(x))
    return F.greatest(F.lit(0.0), F.lit(1.0) - dot)


def fit_rates(soft: DataFrame, names: list[str], targets: dict[str, float], budget: float | None = None,
              steps: int = STEPS, close: float = CLOSE, weights: bool = False) -> tuple[Column, dict]:
    """(rate column over ``soft``, report).  ``soft`` should be a stored table.

    With ``weights`` or a budget in tokens, targets are weights of a total; else preferences.
    """
    d = len(names)
    weight = np.array([max(0.0, targets.get(x, 0.0)) for x in names])
    if not d or not weight.sum():
        return F.lit(1.0), {"steps": 0}
    t = F.col("n_tokens").cast("double")

    def sums(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Reached tokens, G over rates above 0, and sum t r^2 / 2, in one pass."""
        r = _rate(v)
        pairs = [(i, j) for i in range(d) for j in range(i, d)]
        rows = soft.select(t.alias("t"), r.alias("r"), "p").agg(
            *[F.sum(F.expr(f"t * r * p[{j}]")).alias(f"a{j}") for j in range(d)],
            *[F.sum(F.expr(f"CASE WHEN r > 0 THEN t * p[{i}] * p[{j}] END")).alias(f"g{i}_{j}") for i, j in pairs],
            F.sum(F.expr("t * r * r / 2")).alias("half")).first()
        g = np.zeros((d, d))
        for i, j in pairs:
            g[i, j] = g[j, i] = rows[f"g{i}_{j}"] or 0.0
        return np.array([rows[f"a{j}"] or 0.0 for j in range(d)]), g, rows["half"] or 0.0

    v = np.zeros(d)
    now, g, half = sums(v)
    natural = now
    if not natural.sum():
        return F.lit(1.0), {"steps": 0}
    weight = np.where(natural > 0, weight, 0.0)
    if not weight.sum():
        return F.lit(1.0), {"steps": 0}
    if weights or budget is not None:
        weight = weight / weight.sum()
        goal = weight * (min(natural[i] / weight[i] for i in range(d) if weight[i] > 0) if budget is None else budget)
    else:
        goal = natural * weight
    total = goal.sum()
    ridge = np.eye(d) * 1e-9 * np.trace(g)
    done, height = 0, half
    while done < steps and np.abs(now - goal).max() > close * total:
        way = np.linalg.solve(g + ridge, now - goal)
        slope, size = -(now - goal) @ way, 1.0
        while done < steps:
            done += 1
            now, g, half = sums(v + size * way)
            if half + (v + size * way) @ goal <= height + 1e-4 * size * slope + 1e-12 * abs(height):
                break
            size /= 2
        v = v + size * way
        height = half + v @ goal
    return _rate(v), {"steps": done, "goal": dict(zip(names, goal.tolist(), strict=True)),
                      "reached": dict(zip(names, now.tolist(), strict=True))}


def copies(rated: DataFrame, rows: int) -> DataFrame:
    """``rated`` (p, n_tokens, rate, __at) with whole ``copies``; ``__at`` is a number of its own for each row."""
    strata = -(-rows // STRATUM) or 1
    likeliest = F.array_position("p", F.array_max("p"))
    place = Window.partitionBy("__stratum").orderBy(likeliest, "n_tokens", "rate", F.xxhash64("__at"), "__at")
    dealt = rated.withColumn("__stratum", F.pmod(F.xxhash64("__at", F.lit(45)), F.lit(strata)))
    dealt = dealt.withColumn("__sum", F.sum("rate").over(place.rowsBetween(Window.unboundedPreceding, 0)) + F.pmod(F.xxhash64("__stratum"), F.lit(1 << 20)) / F.lit(float(1 << 20)))
    before = F.coalesce(F.lag("__sum").over(place), F.pmod(F.xxhash64("__stratum"), F.lit(1 << 20)) / F.lit(float(1 << 20)))
    return dealt.withColumn("copies", (F.floor(F.col("__sum") + 1e-9) - F.floor(before + 1e-9)).cast("int")).drop("__stratum", "__sum")


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = PREFERENCES, id_col: str = "doc_id", text_col: str = "text",
        domain_col: str = "domain", budget: float | None = None, weights: bool = False, *further: str) -> tuple[DataFrame, list[str]]:
    """((doc_id, n_tokens, p, further columns, rate, copies) of every row, domain names)."""
    ws = Workspace(docs.sparkSession, "mixing")
    domains = learn_domains(docs, labelled, id_col, text_col, domain_col)
    if not domains.names:
        plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.size(words(F.col(text_col))).cast("long").alias("n_tokens"), *further)
        return plain.select("*", F.expr("cast(array() as array<double>)").alias("p"), F.lit(1.0).alias("rate"), F.lit(1).alias("copies")), []
    soft = posteriors(docs, domains, id_col, text_col, *further).withColumn("__at", F.monotonically_increasing_id())
    soft = ws.save(soft, "soft")
    rate, _ = fit_rates(soft, domains.names, targets, budget, weights=weights)
    return copies(soft.select("*", rate.alias("rate")), soft.count()).drop("__at"), domains.names


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of a table of marks: toxic where there is such a mark, else by quality, 1 good, 0 poor."""
    domain = F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    if "toxic" in labels.columns:
        domain = F.when(F.col("toxic") == 1, "toxic").otherwise(domain)
    return labels.select("doc_id", domain.alias("domain"))


def resample(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = PREFERENCES, budget: float | None = None,
             weights: bool = False) -> DataFrame:
    """``docs`` with each row kept as many times as its ``copies``, decided by row: ids may be null or repeated."""
    ws = Workspace(docs.sparkSession, "resample")
    rows = numbered(ws, docs)
    rated, _ = mix(rows, labelled, targets, "doc_id", "text", "domain", budget, weights, "__row")
    decided = ws.save(rated.where("copies <> 1").select("__row", F.col("copies").alias("__times")), "decided")
    few = F.broadcast(decided) if decided.count() <= BROADCAST_IDS else decided  # one join: texts move at most once
    out = rows.join(few, "__row", "left").withColumn("__times", F.coalesce("__times", F.lit(1)))
    return out.where("__times > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*docs.columns)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated, names = mix(documents(spark, sf_dir), label_domains(documents(spark, sf_dir, "labels")), TARGETS, weights=True)
    shares = [F.get("p", F.lit(i)).alias(f"p_{x}") for i, x in enumerate(names)]
    return rated.select("doc_id", "n_tokens", *shares, "rate", "copies")
