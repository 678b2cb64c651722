"""Mixing by soft membership: posteriors of domains learnt from a labelled table, and document rates that meet targets.

Everything is DataFrame expressions.  A naive Bayes model over few features (binned statistics of the whole text and
the presence of telling words) gives each document a posterior per domain.  Rates start at 1 and follow projected
gradient steps of a least squares problem: the expected tokens of each domain, summed over all documents, shall equal
the targets and no rate may be negative.  One step is one distributed sum over a slim table.
"""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tremorline.llm.common import query
from tremorline.session import cut_lineage

LOG = logging.getLogger(__name__)

#: Target shares of tokens in production.
TARGETS = {"good": 0.90, "poor": 0.06, "toxic": 0.04}


@dataclass(frozen=True)
class DomainModel:
    """Log prior per domain (absent words included) and for each feature its addend per domain; bounded size."""

    domains: tuple[str, ...]
    words: tuple[str, ...]
    prior: tuple[float, ...]
    addends: dict[str, tuple[float, ...]]


def domains_of(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The labelled table as ``id, domain``: toxic, poor or good; rows with a null label or id are no examples."""
    return labels.select(F.col(id_col).alias("_id"),
                         F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor")
                         .when(F.col("quality") == 1, "good").alias("domain")).dropna()


def tokens_of(text: Column) -> Column:
    """Words between blanks, lower-cased; null and blank texts have none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[ \\t\\r\\n]+"), "")


def _bin(name: str, part: Column, whole: Column, steps: int) -> Column:
    share = F.when(whole > 0, F.least(F.floor(part * steps / whole), F.lit(steps - 1))).otherwise(0)
    return F.concat(F.lit(f"\n{name} "), share.cast("string"))  # no word begins with a line break


def _statistics(text: Column, tokens: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    size = F.length(text)
    return F.array(
        _bin("capitals", F.regexp_count(text, F.lit("[A-Z]")), size, 20),
        _bin("symbols", F.regexp_count(text, F.lit("[!#$%&*|]")), size, 40),
        _bin("repeats", F.size(tokens) - F.size(F.array_distinct(tokens)), F.size(tokens), 20),
        F.concat(F.lit("\nsize "), F.floor(F.log2(F.size(tokens) + 1)).cast("string")))


def train(docs: DataFrame, examples: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 256,
          least_docs: int = 3, max_rows: int = 8000) -> DomainModel:
    """Fit on at most ``max_rows`` examples ``(_id, domain)``, those of least hash of the id.

    Of several domains of an id the last by name counts.  Without examples there is one domain, named 'all'.
    """
    chosen = (examples.groupBy("_id").agg(F.max("domain").alias("domain"))
              .orderBy(F.xxhash64("_id"), "_id").limit(max_rows))
    sample = cut_lineage(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
                         .join(F.broadcast(chosen), "_id")
                         .withColumn("tokens", tokens_of(F.col("_text")))
                         .select("domain", _statistics(F.col("_text"), F.col("tokens")).alias("statistics"),
                                 F.array_distinct("tokens").alias("tokens")))
    sizes = {r["domain"]: r["n"] for r in sample.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    names = tuple(sorted(sizes))
    if len(names) < 2:
        return DomainModel(names or ("all",), (), (0.0,), {})
    total = sum(sizes.values())

    def counts(column: str) -> DataFrame:
        return (sample.select("domain", F.explode(column).alias("feature")).groupBy("feature")
                .agg(*(F.sum((F.col("domain") == d).cast("long")).alias(f"n_{d}") for d in names)))

    seen = sum(F.col(f"n_{d}") for d in names)
    contrast = F.greatest(*(F.abs(F.col(f"n_{d}") / sizes[d] - (seen - F.col(f"n_{d}")) / max(1, total - sizes[d])) for d in names))
    telling = (counts("tokens").where(seen >= least_docs)
               .orderBy(F.desc(contrast / F.sqrt((seen + 1) / total)), "feature").limit(words).collect())
    prior = {d: math.log(sizes[d] / total) for d in names}
    addends = {}
    for r in telling:
        p = {d: (r[f"n_{d}"] + 0.5) / (sizes[d] + 1) for d in names}
        prior = {d: prior[d] + math.log(1 - p[d]) for d in names}
        addends[r["feature"]] = tuple(math.log(p[d] / (1 - p[d])) for d in names)
    for r in counts("statistics").collect():  # at most 20 + 40 + 20 bins and the logarithms of sizes
        addends[r["feature"]] = tuple(math.log((r[f"n_{d}"] + 0.5) / (sizes[d] + 20)) for d in names)
    return DomainModel(names, tuple(r["feature"] for r in telling), tuple(prior[d] for d in names), addends)


def with_posteriors(docs: DataFrame, model: DomainModel, text_col: str = "text") -> DataFrame:
    """Add ``tokens`` (their number) and ``posterior`` (one share per domain of the model, adding up to 1)."""
    if len(model.domains) == 1:
        return docs.withColumns({"tokens": F.size(tokens_of(F.col(text_col))), "posterior": F.array(F.lit(1.0))})
    known = F.create_map(*[x for f, a in model.addends.items() for x in (F.lit(f), F.array(*map(F.lit, a)))])
    told = F.array_intersect(F.col("_tokens"), F.array(*map(F.lit, model.words)).cast("array<string>"))
    none = F.array(*[F.lit(0.0)] * len(model.domains))
    logs = F.aggregate(F.concat(F.col("_statistics"), told), F.array(*map(F.lit, model.prior)),
                       lambda done, f: F.zip_with(done, F.coalesce(F.try_element_at(known, f), none), lambda a, b: a + b))
    shares = F.transform("_logs", lambda x: F.exp(x - F.array_max("_logs")))
    all_shares = F.aggregate("_shares", F.lit(0.0), lambda a, x: a + x)
    return (docs.withColumn("_tokens", tokens_of(F.col(text_col)))
            .withColumns({"_statistics": _statistics(F.col(text_col), F.col("_tokens")), "tokens": F.size("_tokens")})
            .withColumn("_logs", F.explode(F.array(logs)))
            .withColumn("_shares", F.explode(F.array(shares)))
            .withColumn("posterior", F.transform("_shares", lambda x: x / all_shares))
            .drop("_tokens", "_statistics", "_logs", "_shares"))


def fitted_steps(weighted: DataFrame, domains: tuple[str, ...], targets: dict[str, float], keep: str | None = None,
                 tolerance: float = 1e-4, max_steps: int = 60) -> list[list[float]]:
    """Projected gradient steps, as the amounts each takes off a rate per share of posterior.

    ``weighted`` has ``tokens`` and ``posterior``.  The objective is half the sum over domains of (expected tokens -
    target) squared over the natural tokens of the domain, the target being its share of all tokens, or of as many as
    leave the domain ``keep`` as it is; lengths of rates are weighted by tokens, which makes 1 a safe step.  Domains
    without a target aim at 0; domains without tokens are left out; targets are rescaled to add up to 1.

    Rates are projected onto 0 or more, and onto 1 or more where ``keep`` is the likeliest domain, so none of those
    documents is thinned.  Steps end when the gap is within the tolerance or has stopped shrinking, or after
    ``max_steps``; a gap that is left, as where targets cannot be met under these bounds, is logged.
    """
    share, kept = [F.col("posterior")[i] for i in range(len(domains))], kept_place(domains, keep)

    def expected(steps: list[list[float]]) -> list[float]:
        part = weighted.select("tokens", "posterior", rate(steps, kept).alias("rate"))
        row = part.agg(*(F.coalesce(F.sum(F.col("tokens") * F.col("rate") * s), F.lit(0.0)) for s in share)).first()
        return [float(x) for x in row]

    natural = expected([])
    whole, asked = sum(natural), [targets.get(d, 0.0) for d in domains]
    if not whole or not sum(asked):
        return []
    if keep in domains and targets.get(keep) and natural[domains.index(keep)]:
        whole = natural[domains.index(keep)] * sum(asked) / targets[keep]
    goal = [whole * a / sum(asked) for a in asked]
    steps: list[list[float]] = []
    now, gaps = natural, []
    while True:
        gap = [t - g if n else 0.0 for t, g, n in zip(now, goal, natural)]
        gaps.append(max(map(abs, gap)))
        if gaps[-1] <= tolerance * whole:
            break
        if len(steps) == max_steps or len(gaps) > 5 and gaps[-1] > 0.99 * gaps[-6]:
            LOG.warning("mixing: after %d steps a domain is %.3g of all tokens off its target", len(steps), gaps[-1] / whole)
            break
        steps.append([g / n if n else 0.0 for g, n in zip(gap, natural)])
        now = expected(steps)
    return steps


def kept_place(domains: tuple[str, ...], keep: str | None) -> int | None:
    return domains.index(keep) if keep in domains else None


def rate(steps: list[list[float]], kept: int | None = None) -> Column:
    """The rate of a document with the given ``posterior`` after the steps: 0 or more, and 1 or more where the likeliest
    domain is the one at place ``kept``."""
    least, r = F.lit(0.0), F.lit(1.0)
    if kept is not None:
        least = F.when(F.col("posterior")[kept] >= F.array_max("posterior"), F.lit(1.0)).otherwise(F.lit(0.0))
    for step in steps:
        r = F.greatest(least, r - sum((F.col("posterior")[i] * F.lit(x) for i, x in enumerate(step)), F.lit(0.0)))
    return r


def copies(rate_col: Column, *key: Column) -> Column:
    """A rate as a number of copies: its whole part, and one more for a share of keys as large as the rest."""
    chance = F.pmod(F.xxhash64(F.lit("copies"), *key), F.lit(1 << 30)) / (1 << 30)
    return (F.floor(rate_col) + (chance < rate_col - F.floor(rate_col)).cast("int")).cast("int")


def mixing_rates(docs: DataFrame, examples: DataFrame, targets: dict[str, float], id_col: str = "doc_id",
                 text_col: str = "text", keep: str | None = None, **training) -> tuple[DataFrame, DomainModel, list[list[float]]]:
    """One slim row per row of ``docs`` (``_id, tokens, posterior, rate``), the model and the steps.

    Null and empty texts have no tokens and get the rate of their posterior; null ids and repeated rows stay; an empty
    table has no rates.  Other columns are ignored.
    """
    model = train(docs, examples, id_col, text_col, **training)
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    weighted = cut_lineage(with_posteriors(slim, model, "_text").select("_id", "tokens", "posterior"))
    steps = fitted_steps(weighted, model.domains, targets, keep)
    return weighted.withColumn("rate", rate(steps, kept_place(model.domains, keep))), model, steps


def mixed(docs: DataFrame, examples: DataFrame, targets: dict[str, float], id_col: str = "doc_id",
          text_col: str = "text", keep: str | None = None, **training) -> DataFrame:
    """``docs`` with each row as often as its rate says; the columns are those of ``docs``.

    A rate depends on the posterior only, so it is evaluated again next to the text and no text is shuffled.  Documents
    whose likeliest domain is ``keep`` have at least one copy.  Null and empty texts have the posterior of no words and
    count 0 tokens; null ids, ties and equal rows are treated like any other, equal rows alike; long texts are read whole;
    an empty table, or no usable example, gives ``docs`` as they are.  Other columns pass through, whatever their names.
    """
    _, model, steps = mixing_rates(docs, examples, targets, id_col, text_col, keep, **training)
    names = [f"_c{i}" for i in range(len(docs.columns))]
    own = dict(zip(docs.columns, names))
    plain = docs.toDF(*names)
    n = copies(rate(steps, kept_place(model.domains, keep)), F.col(own[id_col]), F.col(own[text_col]))
    return (with_posteriors(plain, model, own[text_col]).withColumn("_n", n).where("_n > 0")
            .withColumn("_copy", F.explode(F.sequence(F.lit(1), "_n")))
            .select(*(F.col(v).alias(k) for k, v in own.items())))


@query()
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rates, model, _ = mixing_rates(docs, domains_of(labels), TARGETS)
    at = {d: i for i, d in enumerate(model.domains)}
    return rates.select(F.col("_id").alias("doc_id"), F.col("tokens").cast("long").alias("tokens"),
                        *((F.col("posterior")[at[d]] if d in at else F.lit(0.0)).alias(f"p_{d}") for d in TARGETS),
                        "rate", copies(F.col("rate"), F.col("_id")).alias("copies"))
