"""Rows that try the operators: nulls, empty and long texts, ties, copies, taken column names."""

import random

from pyspark.sql import types as T

#: Names that operators give to their own columns, all taken.
CLASHES = ("kept", "keep_id", "group_size", "shard", "slot", "spans", "component_id", "score", "predicted", "held_out", "tokens",
           "rate", "domains", "memberships", "llr", "threshold", "n_words", "size_", "head_", "salt_", "words_", "raw_", "part_", "Fingerprint")
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())]
    + [T.StructField(c, T.StringType()) for c in CLASHES])


def messy_rows():
    """(doc_id, text): nulls, empty and long texts, ties, repeated rows, near copies, personal data."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghé") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts = [prose(rng.randint(1, 120)) for _ in range(60)]
    texts += [None, "", " \n\t ", "one", "two words", "AbC aBc", "abc ABC", "É é", "é É"]
    texts += ["x y z w v " * 30, "line one here\nline one here\n\n line two\nline one here", "\n".join(["a # b"] * 40)]
    texts += ["mail a.b+c@x-y.org, 10.0.0.255, 1.2.3.256 and 0010.1.1.1; 4539 5787 6362 1486 or +49 (0)151 234-5678.",
              "é😀 a@b.c_d@e.f 4539578763621487 +1234 call", "no digits 12", "DE89 3704 0044 0532 0130 00 iban", "ssn 123-45-6789", "1.2.3.4.5.6.7.8.9"]
    long = prose(30_000)
    texts += [long, long + " end", "9" * 50_000, "a" * 50_000 + "@b", "ab@" * 20_000]
    near = prose(300)
    texts += [near, near + " x", near + " y", near.upper(), near.replace(" ", "\n")]
    rows = list(enumerate(texts))
    rows += [(200 + i, t) for i, t in enumerate(rng.choices(texts[:60], k=30))]
    rows += [(7, texts[7]), (7, texts[7]), (7, texts[8]), (None, texts[9]), (None, texts[9]), (None, None), (None, "only here"), (None, "only here")]
    rows += [(500 + i, "hot hot hot copy of one text " * 3) for i in range(90)]
    return rows
