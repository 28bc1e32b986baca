"""Quality rules: a hashed n-gram likelihood ratio of trusted text to the raw corpus, behind plain base rules."""

from __future__ import annotations

import json
import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.llm.filters import bit_filter, slot_of, test_filter
from factorloom.llm.text import body, fresh, let, without, words
from factorloom.session import settle

#: Hash buckets of each n-gram order; bounds every table of counts and weights.
BUCKETS = 1 << 14
#: Pseudo-counts that pull the ratio of a rarely seen bucket towards one.
SHRINK = 8.0
#: Share of trusted documents that the threshold may turn away.
TRUSTED_LOSS = 0.005
#: One trusted document in this many sets the threshold; the others make the target counts.
CALIBRATION = 5
#: Scores are compared on a grid of this many steps a unit, so the threshold is exact and repeatable.
GRID = 1000
BASE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def repeated_words(word_array: Column, width: int = 5) -> Column:
    """How many words stand in a window of ``width`` words that the text has more than once."""

    def covered(windows):
        ranked = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s):
            same = lambda p, j: F.coalesce(F.get(s, j)["h"] == p["h"], F.lit(False))
            return F.array_sort(F.transform(F.filter(s, lambda p, j: same(p, j - 1) | same(p, j + 1)), lambda p: p["i"]))

        begin = F.struct(F.lit(-width).alias("last"), F.lit(0).alias("n"))
        step = lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(width), i - a["last"])).alias("n"))
        return F.aggregate(let(ranked, starts), begin, step, lambda a: a["n"])

    def counted(windows):
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(covered(windows))

    def whole(w):
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))
        return F.when(F.size(w) < width, F.lit(0)).otherwise(let(hashes, counted))

    return let(word_array, whole)


def base_statistics(df: DataFrame, text: str, word_array: str) -> DataFrame:
    """Add the five base counts and ``base_failed``, all from the whole text of the row alone."""
    raw, w = body(f"`{text}`"), F.col(word_array)
    lines = F.filter(F.split(raw, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumns({
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": F.regexp_count(raw, F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(w).cast("long"),
    })
    return df.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def gram_buckets(word_array: Column, buckets: int) -> Column:
    """Buckets of all words and adjacent word pairs: words in [0, buckets), pairs above."""

    def use(w):
        single = F.transform(w, lambda x: F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int"))
        pair = lambda i: (F.pmod(F.xxhash64(F.get(w, i), F.get(w, i + 1)), F.lit(buckets)) + buckets).cast("int")
        pairs = F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(0), F.size(w) - 2), pair))
        return F.concat(single, F.coalesce(pairs, F.array().cast("array<int>")))

    return let(word_array, use)


def gram_weights(docs: DataFrame, trusted: DataFrame, text: str, row_id: str, buckets: int, shrink: float) -> Column:
    """Constant array: the log ratio of each bucket, trusted over raw.

    Both multinomials are counted over all documents; a bucket's expected trusted count is its
    raw count at the trusted share of its order. The table has 2 x buckets rows whatever the
    corpus, so it may pass through the driver and into the plan.
    """
    plain = docs.select(F.col(f"`{row_id}`").alias("id"), body(f"`{text}`").alias("text"))
    # A filter of fixed size finds the rows that may be trusted; only those are shuffled to be told.
    slot = slot_of(F.xxhash64("id"))
    tested = test_filter(plain, slot, bit_filter(trusted.select(slot.alias("slot"))), "may")
    told = tested.where("may").join(trusted.select("id", F.lit(1).alias("good")).hint("merge"), "id", "left").select("text", "good")
    marked = tested.where(~F.col("may")).select("text", F.lit(None).cast("int").alias("good")).union(told)
    grams = marked.select("good", F.explode(gram_buckets(words(F.col("text")), buckets)).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("good").alias("good"))
    order = (F.col("bucket") >= buckets).cast("int")
    shares = counts.groupBy(order.alias("pairs")).agg((F.sum("good") / F.sum("raw")).alias("share"))
    weight = F.log((F.col("good") + shrink) / (F.col("raw") * F.col("share") + shrink))
    rated = counts.withColumn("pairs", order).join(F.broadcast(shares), "pairs").select("bucket", weight.alias("weight"))
    table = [0.0] * (2 * buckets)
    for row in rated.collect():
        table[row["bucket"]] = round(row["weight"], 5)
    return F.from_json(F.lit(json.dumps(table)), "array<double>")


def least_step(bins: list[tuple[int, int]], loss: float) -> int | None:
    """The grid step that turns away a share ``loss`` of documents like the calibration ones, from (step, count) in order.

    With enough of them it is their quantile. If ``loss`` allows for less than one of them, the least
    score says little about so rare a tail (of n, it turns away one in n + 1), and the bound is
    that of a normal fit for one more document, if it lies lower. None for fewer than two.
    """
    n = sum(k for _, k in bins)
    if n < 2:
        return None
    passed = 0
    for step, k in bins:
        passed += k
        if passed > loss * n:
            break
    if loss * n >= 1:
        return step
    mean = sum(s * k for s, k in bins) / n
    spread = math.sqrt(sum(k * (s - mean) ** 2 for s, k in bins) / (n - 1) * (1 + 1 / n))
    return min(step, math.floor(mean + NormalDist().inv_cdf(loss) * spread)) if loss > 0 else bins[0][0]


def score_quality(docs: DataFrame, labels: DataFrame, text: str = "text", row_id: str = "doc_id", quality: str = "quality",
                  buckets: int = BUCKETS, shrink: float = SHRINK, trusted_loss: float = TRUSTED_LOSS) -> DataFrame:
    """All rows of ``docs`` with the base counts, ``llr``, ``threshold`` and ``kept``.

    ``llr`` is the log-likelihood ratio of all words and word pairs between the trusted target
    (rows that every label calls quality 1) and the raw corpus (all rows), both hashed
    multinomials, divided by the number of n-grams. A fifth of the trusted documents, by a hash
    of the id, stays out of the target: they score like unlabelled ones. ``threshold`` is the
    grid step that turns away ``trusted_loss`` of their kind (see ``least_step``). ``kept``: not ``base_failed``, and the
    score's step is at or above the threshold.

    Null text counts as empty: no words, ``llr`` 0, base failed. Rows with a null id are scored
    like others but never trusted. Without any trusted row every ratio is 1 and only the base
    rules decide. Columns named like the new ones are replaced; an empty table gives an empty one.
    """
    docs = without(docs, *BASE_COLUMNS, "llr", "threshold", "kept")
    trusted = (
        labels.where(F.col(row_id).isNotNull())
        .groupBy(F.col(row_id).alias("id"))
        .agg(F.min(quality).alias("q"))
        .where("q = 1")
        .select("id", (F.pmod(F.xxhash64(F.lit("calibration"), "id"), F.lit(CALIBRATION)) == 0).alias("held"))
    )
    target, held = trusted.where("not held").select("id"), trusted.where("held").select("id")
    weights = gram_weights(docs, target, text, row_id, buckets, shrink)
    (array,) = fresh(docs, "words_")

    def scored(df: DataFrame) -> DataFrame:
        df = df.withColumn(array, words(body(f"`{text}`")))
        total = lambda t: F.aggregate(gram_buckets(F.col(array), buckets), F.lit(0.0), lambda a, g: a + F.get(t, g))
        n = 2 * F.size(array) - 1
        return df.withColumn("llr", F.when(n > 0, let(weights, total) / n).otherwise(F.lit(0.0)))

    # Only rows that may be held-out trusted ones are scored for the threshold; all are, once, for the verdict.
    slot = slot_of(F.xxhash64(row_id))
    narrow = docs.select(F.col(f"`{row_id}`").alias(row_id), F.col(f"`{text}`").alias(text))
    narrow = test_filter(narrow, slot, bit_filter(held.select(slot_of(F.xxhash64("id")).alias("slot"))), "may").where("may")
    step = F.floor(F.col("llr") * GRID)
    narrow = settle(scored(narrow).select(F.col(row_id).alias("id"), step.alias("step")), "scores")
    bins = narrow.join(held, "id", "left_semi").groupBy("step").count().orderBy("step").collect()  # grid steps only
    threshold = F.lit(least_step([(r["step"], r["count"]) for r in bins], trusted_loss)).cast("long")
    out = base_statistics(scored(docs), text, array).drop(array)
    verdict = ~F.col("base_failed") & F.coalesce(step >= threshold, F.lit(True))
    return out.withColumn("threshold", threshold / GRID).withColumn("kept", verdict)
