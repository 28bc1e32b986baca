"""Sharding, quality, personal data, exact dedup and mixing against plain versions."""

import collections
import random

import pytest
from brute import LOWER, luhn, personal_data, sha, statistics
from messy_rows import CLASHES, messy_rows
from pyspark.sql import functions as F

from factorloom.llm import exact_dedup, mixing, pii, quality, sharding
from factorloom.llm.text import prefix_sums


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_shards_are_exact_and_gapless(messy, shards):
    rows = sharding.shuffle_into_shards(messy, shards, part_rows=16).select("doc_id", "text", "shard", "slot").collect()
    assert collections.Counter((r.doc_id, r.text) for r in rows) == collections.Counter(messy_rows())
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    sizes = [len(slots[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    again = sharding.shuffle_into_shards(messy.repartition(3), shards, part_rows=16).select("doc_id", "text", "shard", "slot").collect()
    unique = {k for k, n in collections.Counter(messy_rows()).items() if n == 1}
    place = lambda rs: {(r.doc_id, r.text): (r.shard, r.slot) for r in rs if (r.doc_id, r.text) in unique}
    assert place(rows) == place(again)  # the input's partitions don't matter


def test_shards_of_nothing(nothing):
    assert sharding.shuffle_into_shards(nothing, 4).count() == 0


def test_hypergeometric_has_its_mean_and_spread():
    rng = random.Random(1)
    draws = [sharding.hypergeometric(300, 700, 100, rng) for _ in range(4000)]
    mean = sum(draws) / len(draws)
    spread = sum((x - mean) ** 2 for x in draws) / len(draws)
    assert abs(mean - 30) < 0.3 and abs(spread - 100 * 0.3 * 0.7 * 900 / 999) < 1.2
    assert {sharding.hypergeometric(0, 5, 3, rng), sharding.hypergeometric(5, 0, 3, rng)} == {0, 3}
    big = sharding.hypergeometric(10**10, 39 * 10**10, 10**7, rng)
    assert abs(big - 250_000) < 5_000


def test_matrix_keeps_both_sums():
    m = sharding.communication_matrix([5, 0, 17, 3], [9, 8, 8], 3)
    assert [sum(r) for r in m] == [5, 0, 17, 3] and [sum(c) for c in zip(*m, strict=True)] == [9, 8, 8]


def test_shuffle_is_uniform(spark):
    """Every row is as likely in every shard: a chi-square over seeds."""
    df, seen = spark.range(12).withColumnRenamed("id", "doc_id").withColumn("text", F.lit("t")), collections.Counter()
    for seed in range(60):
        for r in sharding.shuffle_into_shards(df, 3, seed=seed).collect():
            seen[r.doc_id, r.shard] += 1
    chi = sum((seen[d, s] - 20) ** 2 / 20 for d in range(12) for s in range(3))
    assert chi < 60  # 24 degrees of freedom


def test_base_statistics_equal_brute_force(messy, labels):
    out = quality.score_quality(messy, labels)
    for r in out.collect():
        n, chars, symbols, lines, repeats = statistics(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeats)
        assert r.base_failed == (n < 10 or 100 * repeats > 20 * n)
        assert not (r.base_failed and r.kept)
    assert out.count() == len(messy_rows())


def test_quality_prefers_trusted_text(spark):
    rng = random.Random(3)
    good, bad = [f"good{i}" for i in range(200)], [f"bad{i}" for i in range(200)]
    rows = [(i, " ".join(rng.choice(good if i % 2 else bad) for _ in range(60))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in quality.score_quality(docs, marks).collect()}
    assert all(kept[i] == bool(i % 2) for i in range(200, 400))


def test_threshold_of_few_and_of_many_calibration_rows():
    rng = random.Random(4)
    lost = []
    for n in (8, 20, 60):
        for _ in range(150):
            bins = sorted(collections.Counter(round(rng.gauss(1000, 60)) for _ in range(n)).items())
            low = quality.least_step(bins, 0.005)
            lost.append(sum(rng.gauss(1000, 60) < low for _ in range(200)) / 200)
    assert sum(lost) / len(lost) < 0.02  # the least score alone loses a 9th, a 21st and a 61st
    many = [(k, 10) for k in range(1000)]
    assert quality.least_step(many, 0.005) == 5 and quality.least_step([(3, 1)], 0.005) is None and quality.least_step([], 0.1) is None


def test_quality_without_labels_or_rows(messy, nothing, labels):
    none = labels.where("quality > 5")
    assert all(r.kept != r.base_failed for r in quality.score_quality(messy, none).collect())
    assert quality.score_quality(nothing, labels).count() == 0


def test_personal_data_equals_brute_force(messy):
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    for r in pii.find_personal_data(messy).select("text", pii.as_text(base).alias("spans")).collect():
        assert r.spans == ",".join(personal_data(r.text))


def test_further_kinds_need_checksum_or_context(spark):
    texts = ["DE89 3704 0044 0532 0130 00", "DE88 3704 0044 0532 0130 00", "ssn 123-45-6789", "order 123-45-6789", "ssn 000-45-6789"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    kinds = [[s.kind for s in r.spans] for r in pii.find_personal_data(df).collect()]
    assert ["iban" in k for k in kinds[:2]] == [True, False]
    assert ["ssn" in k for k in kinds[2:]] == [True, False, False]


def test_words_behind_an_iban_are_not_taken(spark):
    ibans = ["ES91 2100 0418 4502 0005 1332", "BE68 5390 0754 7034", "AT61 1904 3002 3457 3201", "DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947"]
    rows = [(i, x + end) for i, x in enumerate(ibans) for end in (" BIC: X", " BIC", " A1", " ABCD", ", then", "")]
    out = pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [[s["end"] for s in r.spans if s["kind"] == "iban"] for r in out] == [[len(ibans[r.doc_id])] for r in out]


def test_redaction(spark):
    df = spark.createDataFrame([("é😀 mail a@b.co or +49 151 2345678!",), (None,), ("none",)], "text string")
    got = [r.text for r in pii.redact(pii.find_personal_data(df)).collect()]
    assert got == ["é😀 mail [email] or [phone]!", None, "none"]


def test_luhn_of_brute_force():
    assert luhn("4539578763621486") and not luhn("4539578763621487")


def test_prefix_sums(spark):
    df = spark.range(1).select(prefix_sums(F.array(*[F.lit(i % 7) for i in range(40)]), 8).alias("s"), prefix_sums(F.array().cast("array<int>")).alias("e"))
    r = df.first()
    assert r.s == [sum(i % 7 for i in range(k)) for k in range(40)] and r.e == []


@pytest.mark.parametrize("filter_words", [1, 1 << 10])
def test_exact_dedup_equals_brute_force(messy, filter_words):
    """A full filter (one word) only costs hashing."""
    groups = collections.defaultdict(list)
    for k, t in messy_rows():
        groups[(t or "").translate(LOWER)].append(k)
    kept = collections.Counter()
    for r in exact_dedup.mark_copies(messy, filter_words=filter_words).collect():
        ids = groups[(r.text or "").translate(LOWER)]
        known = [i for i in ids if i is not None]
        assert r.group_size == len(ids) and r.keep_id == (max(known) if known else None)
        kept[(r.text or "").translate(LOWER)] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1} and set(kept) == set(groups)


def test_dropping_copies_keeps_columns(messy, nothing):
    out = exact_dedup.drop_copies(messy)
    assert out.columns == messy.columns and set(CLASHES) <= set(out.columns)
    assert {r.kept for r in out.collect()} <= {None, "mine"}
    assert exact_dedup.mark_copies(nothing).count() == 0


def mixture(spark, n=300):
    rng = random.Random(9)
    kinds = {"a": [f"a{i}" for i in range(50)], "b": [f"b{i}" for i in range(50)], "c": [f"c{i}" for i in range(50)]}
    rows = []
    for i in range(n):
        kind = "aab"[i % 3] if i % 5 else "c"
        other = rng.choice("abc")
        rows.append((i, " ".join(rng.choice(kinds[kind if rng.random() < 0.8 else other]) for _ in range(rng.randint(5, 80))), kind))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 2], "id long, domain string"), {r[0]: r[2] for r in rows}


@pytest.mark.parametrize("least", [0.0, 1.0])
def test_rates_meet_targets(spark, least):
    docs, labelled, kinds = mixture(spark)
    want = {"a": 0.3, "b": 0.3, "c": 0.4}
    rows = mixing.fit_mixture(docs, labelled, want, least=least).collect()
    totals = [sum(r.tokens * r.rate * r.memberships[k] for r in rows) for k in range(3)]
    assert rows[0].domains == ["a", "b", "c"] and min(r.rate for r in rows) >= least
    assert all(abs(t / sum(totals) - w) < 1e-3 for t, w in zip(totals, want.values(), strict=True))
    assert all(abs(sum(r.memberships) - 1) < 1e-9 for r in rows)
    right = sum(kinds[r.doc_id] == r.domains[max(range(3), key=lambda k: r.memberships[k])] for r in rows)
    assert right > 0.9 * len(rows)


def test_drawn_mixture_keeps_every_row(spark, messy, labels):
    docs, labelled, _ = mixture(spark)
    drawn = mixing.draw_mixture(docs, labelled, {"a": 0.2, "b": 0.4, "c": 0.4}, least=1.0)
    times = collections.Counter(r.doc_id for r in drawn.collect())
    assert set(times) == set(range(300)) and max(times.values()) > 1
    out = mixing.draw_mixture(messy, mixing.label_domains(labels), {"q1t0": 0.9, "q0t0": 0.1}, least=1.0)
    assert out.columns == messy.columns and set(map(lambda r: (r.doc_id, r.text), out.collect())) == set(messy_rows())


def test_mixing_nothing(messy, nothing, labels):
    domains = mixing.label_domains(labels)
    assert mixing.fit_mixture(nothing, domains, {"q1t0": 1.0}).count() == 0
    rows = mixing.fit_mixture(messy, domains.where("id < 0"), {"q1t0": 1.0}).collect()
    assert {r.rate for r in rows} == {1.0} and len(rows) == len(messy_rows())
