"""Toxicity by weak supervision: many voters, a generative model of their votes, a linear classifier."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.llm.components import connected_components
from factorloom.llm.near_copies import link_texts, with_sketches
from factorloom.llm.text import body, ready_for_python, set_aside, without
from factorloom.session import settle

#: Labelled documents that lexicons, label model and classifier are fitted on, at most (the ones
#: with the smallest hash of their id). Scoring covers every row.
MAX_LABELLED = 20_000
#: Lexicon entries at most, strongest first.
MAX_ENTRIES = 2_048
#: A lexicon entry stands in this many distinct toxic texts of the sample,
MIN_TOXIC = 4
#: its log odds less two standard errors reach this,
MIN_ODDS = 2.0
#: and its share of toxic texts is this many times its share of clean ones.
MIN_RATIO = 50
#: Lexicon voters of each entry kind; the surest entries make the first, and so on.
VOTERS_PER_KIND = 6
#: Voters correlated less than this count as independent.
LEAST_CORRELATION = 0.3
#: Prefix lengths that make entry kinds beside the whole word (length 0).
PREFIXES = (0, 4, 5, 6)
#: Words whose entries a worker keeps at hand.
CACHE_WORDS = 150_000

WORD = re.compile(r"[^\W\d_]+")
# Patterns that vote toxic, and patterns that vote clean.
SHOUTS = (re.compile(r"!{2,}"), re.compile(r"\b[A-Z]{5,}\b"), re.compile(r"[!?]{3,}"), re.compile(r"[@#$%&*]{3,}"))
CALM = (re.compile(r"\.\s"), re.compile(r",\s"))


def entries_of(word: str) -> list[str]:
    """Lexicon entries that a lower-cased word can match: itself and its prefixes."""
    return [f"0{word}"] + [f"{n}{word[:n]}" for n in PREFIXES[1:] if len(word) >= n]


def _count_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either label that hold each entry, added up within a batch."""
    for batch in batches:
        counts = (Counter(), Counter())
        for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
            counts[toxic].update({e for w in set(WORD.findall(text.lower())) for e in entries_of(w)})
        names = list(counts[0].keys() | counts[1].keys())
        yield pa.record_batch({
            "entry": pa.array(names, pa.string()),
            "clean": pa.array([counts[0][e] for e in names], pa.int64()),
            "toxic": pa.array([counts[1][e] for e in names], pa.int64()),
        })


@dataclass
class Model:
    """What scoring needs: entries with their weights, pattern weights and a bias."""

    entries: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -20.0
    voters: list[dict] = field(default_factory=list)


def hits(text: str, entries: dict[str, int], cache: dict[str, tuple]) -> set[int]:
    """Indices of the entries and patterns that occur in a whole text."""
    found: set[int] = set()
    for word in set(WORD.findall(text.lower())):
        own = cache.get(word)
        if own is None:
            if len(cache) >= CACHE_WORDS:
                cache.clear()
            own = cache[word] = tuple(entries[e] for e in entries_of(word) if e in entries)
        if own:
            found.update(own)
    at = len(entries)
    found.update(at + k for k, p in enumerate(SHOUTS + CALM) if p.search(text))
    return found


def deal_entries(chosen: list[str]) -> np.ndarray:
    """The voter of each entry: by kind, and in a kind by place, surest first."""
    kinds = [PREFIXES.index(int(e[0])) for e in chosen]
    sizes, seen, out = Counter(kinds), Counter(), []
    for kind in kinds:
        out.append(kind * VOTERS_PER_KIND + seen[kind] * VOTERS_PER_KIND // sizes[kind])
        seen[kind] += 1
    return np.array(out, np.int64)


def votes_of(found: list[set[int]], voter_of: np.ndarray, n_entries: int) -> np.ndarray:
    """Documents x voters: 1 toxic, -1 clean, 0 abstains."""
    lexicon = len(PREFIXES) * VOTERS_PER_KIND
    votes = np.zeros((len(found), lexicon + len(SHOUTS) + len(CALM) + 1), np.int8)
    for i, own in enumerate(found):
        for k in own:
            if k < n_entries:
                votes[i, voter_of[k]] = 1
            else:
                votes[i, lexicon + k - n_entries] = 1 if k - n_entries < len(SHOUTS) else -1
        if not any(k < n_entries for k in own):
            votes[i, -1] = -1  # no lexicon knows this text
    return votes


def fit_label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(posterior, log odds of a vote, damping, correlations) of a hidden label behind the votes.

    Expectation maximisation that starts from the sample's own labels and then trusts the
    votes alone. A voter's log odds is how much likelier its vote is under one label than
    under the other. Two voters of a side are correlated if they vote alike beyond what the
    hidden label explains; a voter counts by one over the sum of its correlations, so a
    family of copies weighs as much as one voter.
    """
    cast = (votes != 0).astype(float)
    same_side = np.equal.outer((votes > 0).any(0), (votes > 0).any(0))
    prior = float(np.clip(labels.mean(), 0.001, 0.5))
    start, post = np.log(prior / (1 - prior)), np.clip(labels.astype(float), 0.02, 0.98)
    for _ in range(rounds):
        before = post
        yes, no = cast.T @ post, cast.T @ (1 - post)
        rate_yes, rate_no = (yes + 0.5) / (post.sum() + 1), (no + 0.5) / ((1 - post).sum() + 1)
        odds = np.log(rate_yes / rate_no)
        rest = cast - np.outer(post, rate_yes) - np.outer(1 - post, rate_no)  # what the label leaves open
        cov = rest.T @ rest / len(votes)
        sd = np.sqrt(np.diag(cov)) + 1e-9
        corr = cov / np.outer(sd, sd)
        np.fill_diagonal(corr, 1.0)
        damp = 1 / np.where(same_side & (corr > LEAST_CORRELATION), corr, 0).sum(0)
        post = 1 / (1 + np.exp(-np.clip(start + cast @ (damp * odds), -30, 30)))
        if np.abs(post - before).max() < 1e-6:
            break
    return post, odds, damp, corr


def fit_linear(found: list[set[int]], soft: np.ndarray, size: int, rounds: int = 300, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression of soft labels on presence features, by accelerated gradient steps."""
    row = np.repeat(np.arange(len(found)), [len(f) for f in found])
    col = np.fromiter((k for f in found for k in sorted(f)), np.int64, len(row))
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(col, minlength=size)))  # rare features learn as fast as common ones
    value = scale[col]
    w, bias = np.zeros(size), float(np.log((soft.mean() + 1e-6) / (1 - soft.mean() + 1e-6)))
    speed, drift = np.zeros(size), 0.0
    step = 4.0 / (1 + np.bincount(row, minlength=len(found)).max(initial=0))
    for _ in range(rounds):
        z = np.bincount(row, value * w[col], minlength=len(found)) + bias
        gap = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - soft
        speed = 0.9 * speed - step * (np.bincount(col, value * gap[row], minlength=size) + ridge * w)
        drift = 0.9 * drift - step * gap.mean()
        w, bias = w + speed, bias + drift
    return w * scale, bias


def calibrate(z: np.ndarray, labels: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift that make the classifier's log odds those of the sample's labels."""
    yes, no = labels.sum(), (1 - labels).sum()
    goal = np.where(labels == 1, (yes + 1) / (yes + 2), 1 / (no + 2))
    x = np.stack([z, np.ones(len(z))], 1)
    start = at = np.array([1.0, 0.0])
    keep = np.diag([1e-2, 1e-4])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        slope = x.T @ (p - goal) + keep @ (at - start)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep + 1e-9 * np.eye(2), slope)
        at = at - step / max(1.0, np.abs(step).max())
    return (float(max(at[0], 1e-3)), float(at[1]))


def held_out(row_id: str) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(f"`{row_id}`").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def count_once(rows: DataFrame) -> DataFrame:
    """One text of each label for each component of near copies (``near_copies``) in ``rows`` (toxic, text).

    Near copies of a toxic text would make all its words look toxic. Every other text counts,
    however it begins.
    """
    sketched = settle(with_sketches(rows, "text", "sketch"), "sketches")
    parts = connected_components(link_texts(sketched, "text", "sketch")).select(F.col("u").alias("fp"), F.col("v").alias("least"))
    placed = sketched.select("toxic", "text", F.col("sketch.shingles").alias("fp")).join(parts, "fp", "left")
    return settle(placed.groupBy(F.coalesce("least", "fp").alias("group"), "toxic").agg(F.min("text").alias("text")).select("toxic", "text"), "counted")


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", row_id: str = "doc_id", label: str = "toxic") -> Model:
    """Learn from at most MAX_LABELLED labelled rows that aren't held out.

    Their documents' words and word prefixes that lean to the toxic label become lexicons,
    dealt to many voters; patterns vote too. The label model then weighs the votes, and the
    classifier sees its posteriors only; its log odds are then scaled to the sample's labels. Without labelled toxic rows the model knows nothing
    and scores every text near 0.
    """
    ready_for_python(docs.sparkSession)
    known = labels.where(F.col(label).isNotNull() & F.col(row_id).isNotNull()).where(~held_out(row_id))
    known = known.groupBy(F.col(row_id).alias("id")).agg(F.max(label).cast("int").alias("toxic"))
    sample = known.orderBy(F.xxhash64("id"), "id").limit(MAX_LABELLED)
    plain = docs.select(F.col(f"`{row_id}`").alias("id"), body(f"`{text}`").alias("text"))
    rows = settle(plain.join(F.broadcast(sample), "id").select("toxic", "text"), "labelled")  # MAX_LABELLED rows at most

    distinct = count_once(rows)
    totals = {r["toxic"]: r["count"] for r in distinct.groupBy("toxic").count().collect()}
    n_toxic, n_clean = totals.get(1, 0), totals.get(0, 0)
    if not n_toxic:
        return Model()
    counted = distinct.mapInArrow(_count_entries, "entry string, clean long, toxic long")
    counted = counted.groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    yes, no = F.col("toxic") + 0.5, F.col("clean") + 0.5
    ratio = yes / (n_toxic + 1.0) * (n_clean + 1.0) / no
    surest = F.log(ratio) - 2 * F.sqrt(1 / yes + 1 / no)
    strong = counted.where((F.col("toxic") >= MIN_TOXIC) & (ratio >= MIN_RATIO)).withColumn("odds", surest).where(F.col("odds") >= MIN_ODDS)
    chosen = [r["entry"] for r in strong.orderBy(F.desc("odds"), "entry").limit(MAX_ENTRIES).collect()]
    entries, voter_of = {e: k for k, e in enumerate(chosen)}, deal_entries(chosen)

    def found_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple] = {}
        for batch in batches:
            yield pa.record_batch({"toxic": batch["toxic"], "found": pa.array([sorted(hits(t, entries, cache)) for t in batch["text"].to_pylist()], pa.list_(pa.int32()))})

    seen = rows.mapInArrow(found_in, "toxic int, found array<int>").collect()  # MAX_LABELLED rows
    found = [set(r["found"]) for r in seen]
    votes = votes_of(found, voter_of, len(entries))
    marks = np.array([r["toxic"] for r in seen])
    soft, odds, damp, corr = fit_label_model(votes, marks)
    weights, bias = fit_linear(found, soft, len(entries) + len(SHOUTS) + len(CALM))
    slope, shift = calibrate(np.array([bias + weights[sorted(f)].sum() for f in found]), marks)
    weights, bias = slope * weights, slope * bias + shift
    voters = [{"votes": int((votes[:, j] != 0).sum()), "log_odds": float(odds[j]), "damping": float(damp[j]),
               "correlated": [int(k) for k in np.flatnonzero(corr[j] > LEAST_CORRELATION) if k != j]} for j in range(votes.shape[1])]
    return Model(entries, weights, bias, voters)


def score_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """All rows of ``docs`` with ``held_out``, ``score`` (0 to 1) and ``predicted`` (score >= 0.5).

    The score depends on the whole text only. Null and empty texts get the score of a text
    without any hit. A null id is never held out nor learned from. Columns named like the new
    ones are replaced; an empty table gives an empty one.
    """
    docs = without(docs, "held_out", "score", "predicted")
    model = fit(docs, labels, text, row_id)
    entries, weights, bias = model.entries, model.weights, model.bias

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache: dict[str, tuple] = {}
        for texts in batches:
            z = [bias + sum(weights[k] for k in hits(t.as_py() or "", entries, cache)) if entries else bias for t in texts]
            yield pa.array(1 / (1 + np.exp(-np.clip(np.array(z, float), -30, 30))), pa.float64())

    return (
        docs.withColumn("held_out", held_out(row_id))
        .withColumn("score", scored(F.col(f"`{text}`")))
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with their own columns."""
    aside, restore = set_aside(docs, "held_out", "score", "predicted")
    return score_toxicity(aside, labels, text, row_id).where("predicted = 0").select(*restore)
