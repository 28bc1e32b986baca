"""Mixing to target weights: soft domain membership, then document rates by projected gradient."""

from __future__ import annotations

import json
import math

import numpy as np

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.llm.text import body, fresh, let, set_aside, without, words
from factorloom.session import settle

#: Hash buckets of the classifier's words; bounds its tables.
BUCKETS = 1 << 12
#: Labelled documents that the classifier is fitted on, at most (smallest hash of the id).
MAX_LABELLED = 20_000
#: Domains at most; bounds the classifier and the least squares problem.
MAX_DOMAINS = 64
#: Gradient rounds at most, and the error of a domain total, of all tokens, at which they end.
MAX_ROUNDS, TOLERANCE = 40, 1e-6


def label_domains(labels: DataFrame, row_id: str = "doc_id") -> DataFrame:
    """(id, domain) of the label table: one domain for each pair of labels a document can have."""
    known = labels.where(F.col(row_id).isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    one = known.groupBy(F.col(row_id).alias("id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    return one.select("id", F.concat(F.lit("q"), "q", F.lit("t"), "t").alias("domain"))


def _buckets(word_array: Column) -> Column:
    return F.transform(word_array, lambda w: (F.pmod(F.xxhash64(w), F.lit(BUCKETS)) + 1).cast("int"))


def fit_domains(docs: DataFrame, labelled: DataFrame, text: str = "text", row_id: str = "doc_id") -> list[tuple[str, float, list[float]]]:
    """(domain, log prior, log word probabilities by bucket) of a multinomial classifier.

    Fitted on at most MAX_LABELLED labelled rows; the tables have MAX_DOMAINS x BUCKETS numbers at most.
    """
    sample = labelled.orderBy(F.xxhash64("id"), "id").limit(MAX_LABELLED)
    plain = docs.select(F.col(f"`{row_id}`").alias("id"), body(f"`{text}`").alias("text"))
    rows = plain.join(F.broadcast(sample), "id")
    counts = rows.select("domain", F.explode(_buckets(words(F.col("text")))).alias("b")).groupBy("domain", "b").count().collect()
    sizes = {r["domain"]: r["count"] for r in rows.groupBy("domain").count().collect()}
    if len(sizes) > MAX_DOMAINS:
        raise ValueError(f"{len(sizes)} domains; at most {MAX_DOMAINS} are supported")
    total, out = sum(sizes.values()), []
    for name in sorted(sizes):
        seen = [0.5] * BUCKETS
        for r in counts:
            if r["domain"] == name:
                seen[r["b"] - 1] += r["count"]
        whole = sum(seen)
        out.append((name, math.log(sizes[name] / total), [round(math.log(x / whole), 5) for x in seen]))
    return out


def with_memberships(docs: DataFrame, model: list[tuple[str, float, list[float]]], text: str, tokens: str, member: str) -> DataFrame:
    """Add ``tokens`` (words, 1 at least) and ``member``, the domain posteriors as an array.

    Evidence is the mean log probability of a text's words times the square root of their
    number: words of one text aren't independent, and memberships stay soft.
    """
    tables = [F.from_json(F.lit(json.dumps(m[2])), "array<double>") for m in model]

    def logits(b: Column) -> Column:
        total = lambda k: F.aggregate(b, F.lit(0.0), lambda a, x: a + F.element_at(tables[k], x))
        size = F.greatest(F.lit(1), F.size(b))
        return F.array(*[F.lit(m[1]) + total(k) / F.sqrt(size) for k, m in enumerate(model)])

    def soft(z: Column) -> Column:
        parts = F.transform(z, lambda x: F.exp(x - F.array_max(z)))
        return let(parts, lambda p: F.transform(p, lambda x: x / F.aggregate(p, F.lit(0.0), lambda a, y: a + y)))

    (found,) = fresh(docs, "buckets_")
    docs = docs.withColumn(found, _buckets(words(body(f"`{text}`"))))
    docs = docs.withColumn(tokens, F.greatest(F.lit(1), F.size(found)).cast("long"))
    return docs.withColumn(member, let(let(F.col(found), logits), soft)).drop(found)


def _rate(member: str, history: list[list[float]], least: float) -> Column:
    """A row's rate after the gradient steps in ``history``, from its memberships alone."""
    rate = F.lit(max(1.0, least))
    for step in history:
        move = sum((F.get(F.col(member), k) * F.lit(c) for k, c in enumerate(step)), F.lit(0.0))
        rate = F.greatest(F.lit(least), rate - move)
    return rate


def fit_rates(members: DataFrame, domains: list[str], weights: dict[str, float], least: float, member: str = "memberships",
              tokens: str = "tokens") -> list[list[float]]:
    """Gradient steps whose fold over a row's memberships is its rate.

    ``members`` is a written table. Projected gradient on the squared errors of all domains'
    expected tokens against their targets, over rates of at least ``least``. A step is
    scaled by the inverse of the problem's Gram matrix over the rows that may still move, so
    few rounds are needed; a step that would not lessen the error is halved, and rounds end once a
    step lessens it by less than a hundredth. A round is one
    distributed sum of a few numbers a pair of domains, whatever the number of rows.

    Targets: ``weights`` (missing domains keep their share), in proportion, of the smallest total
    that asks no domain for less than ``least`` of what it has, or of all tokens if ``least`` is 0.
    """
    k = len(domains)
    each = [F.get(F.col(member), i) for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def measure(history: list[list[float]], pull: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected tokens of each domain, and the Gram matrix over rows that may move: those
        above ``least``, and those that the errors ``pull`` draw away from it."""
        rated = members.withColumn("_rate", _rate(member, history, least))
        drawn = sum((p * F.lit(float(g)) for p, g in zip(each, pull, strict=True)), F.lit(0.0)) < 0
        free = F.when((F.col("_rate") > least) | drawn, F.col(tokens)).otherwise(0)
        sums = [F.sum(F.col(tokens) * F.col("_rate") * p) for p in each] + [F.sum(free * each[i] * each[j]) for i, j in pairs]
        row = [x or 0.0 for x in rated.agg(*[x.alias(f"s{n}") for n, x in enumerate(sums)]).first()]
        gram = np.zeros((k, k))
        for (i, j), x in zip(pairs, row[k:], strict=True):
            gram[i, j] = gram[j, i] = x
        return np.array(row[:k]), gram

    base = np.array([x or 0.0 for x in members.agg(*[F.sum(F.col(tokens) * p).alias(f"b{n}") for n, p in enumerate(each)]).first()])
    total = base.sum()
    if not total:
        return []
    asked = np.array([weights.get(d, 0.0) for d in domains])
    named = np.array([d in weights for d in domains])
    share = base / total
    if asked.sum() > 0:
        share = np.where(named, asked / asked.sum() * (1 - share[~named].sum()), share)
    whole = max((least * b / w for b, w in zip(base, share, strict=True) if w > 0), default=total) if least else total
    target = share * whole

    history: list[list[float]] = []
    now, gram = measure(history, max(1.0, least) * base - target)
    size = 1.0
    for _ in range(MAX_ROUNDS):
        gap = now - target
        if np.abs(gap).max() <= TOLERANCE * whole or size < 1e-3:
            break
        ridge = 1e-9 * max(np.trace(gram), total) / k
        step = size * np.linalg.solve(gram + ridge * np.eye(k) + 1e-6 * np.diag(base), gap)
        then, after = measure([*history, step.tolist()], gap)
        if np.linalg.norm(then - target) < np.linalg.norm(gap):
            history, now, gram, size = [*history, step.tolist()], then, after, min(1.0, 2 * size)
            if np.linalg.norm(then - target) > 0.99 * np.linalg.norm(gap):
                break  # the bound leaves no better rates
        else:
            size /= 2
    return history


def fit_mixture(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], text: str = "text", row_id: str = "doc_id",
                least: float = 0.0) -> DataFrame:
    """All rows of ``docs`` with ``tokens``, ``domains``, ``memberships`` and ``rate``.

    ``labelled`` has (id, domain); ``weights`` the domains' target shares of tokens. ``rate``
    is how often a document should be seen, ``least`` at least. Null and empty texts count
    one token and get the prior memberships. Without labelled rows there are no domains and
    every rate is 1. Columns named like the new ones are replaced; an empty table gives an
    empty one.
    """
    docs = without(docs, "tokens", "domains", "memberships", "rate")
    model = fit_domains(docs, labelled, text, row_id)
    names = [m[0] for m in model]
    if not names:
        blank = {"tokens": F.greatest(F.lit(1), F.size(words(body(f"`{text}`")))).cast("long"),
                 "domains": F.array().cast("array<string>"), "memberships": F.array().cast("array<double>"), "rate": F.lit(max(1.0, least))}
        return docs.withColumns(blank)
    out = settle(with_memberships(docs, model, text, "tokens", "memberships"), "members")
    history = fit_rates(out.select("tokens", "memberships"), names, weights, least)
    out = out.withColumn("domains", F.array(*[F.lit(n) for n in names]))
    return out.withColumn("rate", _rate("memberships", history, least)).select(*docs.columns, "tokens", "domains", "memberships", "rate")


def draw_mixture(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], text: str = "text", row_id: str = "doc_id",
                 least: float = 0.0) -> DataFrame:
    """``docs`` with every row as often as its rate says: the whole part, and once more by a
    hash of id and text for the fraction. With ``least`` 1 no row is lost."""
    aside, restore = set_aside(docs, "tokens", "domains", "memberships", "rate")
    rated = fit_mixture(aside, labelled, weights, text, row_id, least)
    chance = F.pmod(F.xxhash64(F.lit("mixture"), F.col(f"`{row_id}`"), F.col(f"`{text}`")), F.lit(1 << 30)) / (1 << 30)
    copies = F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("int")
    (copy,) = fresh(rated, "copy_")
    drawn = rated.withColumn(copy, copies.cast("int")).where(F.col(copy) > 0)
    return drawn.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copy)))).select(*restore)
