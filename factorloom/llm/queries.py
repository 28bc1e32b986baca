"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm import (chat, decontaminate, exact_dedup, merkle, mixing, oracles, packed_ids, packing, pii, quality, repair, sharding,
                            simhash, toxicity)
from factorloom.llm.places import key_of
from factorloom.llm.text import ascii_lower, body, fresh
from factorloom.session import settle


#: Target shares of tokens by domain of the label table.
TARGETS = {"q1t0": 0.85, "q1t1": 0.05, "q0t0": 0.08, "q0t1": 0.02}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public tokenizer file, the same on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shuffle_into_shards(table(spark, sf_dir, "documents"), 40)
    return out.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(body("text").cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", *quality.BASE_COLUMNS, "kept", "llr", "threshold")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    path = tokenizer_path()
    return chat.read_back(chat.written(chat.format_turns(turns.unionByName(extra), path)), path)


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find_personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return out.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in pii.BASE_KINDS],
        F.sha2(pii.as_text(base).cast("binary"), 256).alias("base_sha256"),
        pii.as_text(F.col("spans")).alias("spans"),
    )


def op5_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = packed_ids.write_ids(table(spark, sf_dir, "documents"), tokenizer_path())
    return packed_ids.read_documents(manifest)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    domains = mixing.label_domains(table(spark, sf_dir, "labels"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = mixing.fit_mixture(docs, domains, TARGETS)
    return out.select("doc_id", "tokens", "domains", "memberships", "rate")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The digest of every text is asked for, so it is taken in the scan and passes through the
    # operator as a further column; the text then needs no shuffle.
    docs = table(spark, sf_dir, "documents")
    docs = docs.withColumn("text_sha256", F.sha2(ascii_lower(body("text")).cast("binary"), 256))
    return exact_dedup.mark_copies(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    printed = settle(simhash.with_fingerprints(docs).drop("text"), "fingerprints")
    out = simhash.group_near_copies(printed)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fields = table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"]
    (changed,) = fresh(docs, "changed")
    tampered = merkle.leaf_of([F.col(c) + 1 if c == "n_chars" else F.col(c) for c in fields])
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    listed = merkle.manifest(docs.withColumn(changed, F.when(chosen, tampered)), fields, "lang", "doc_id", keep=[changed])
    siblings = F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), "")
    out = listed.withColumn("folded_root", merkle.fold(F.coalesce(changed, "leaf"), F.col("proof")))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"),
                      "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with some rows dropped, emptied, cut, doubled or given to the user, by a checksum of their place."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    turns = turns.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"),
                         (F.crc32(F.concat_ws(":", shown("conv_id"), shown("turn")).cast("binary")) % 20).alias("fate"))
    fate = F.col("fate")
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(fate == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(fate == 3, 2).otherwise(1)))
    return turns.where(fate != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("time")).drop("time")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    mended = repair.repair_conversations(damaged(turns))
    sums = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    every = turns.select("conv_id", key_of("conv_id").alias("key")).distinct()
    out = every.join(mended.reports.drop("conv_id"), "key", "left").join(repair.digests(mended), "key", "left")
    return out.select("conv_id", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in sums],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_sharding, op2_quality, op3_chat, op4_personal_data, op5_packed_ids, op6_mixing, op7_exact_dedup, op8_packing,
           op9_simhash, op10_toxicity, op11_decontamination, op12_merkle, op13_repair)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return {
        "op7_exact_dedup": f"""
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
            FROM (SELECT doc_id, translate(coalesce(text, ''), '{upper}', '{lower}') AS t FROM documents)
            WINDOW w AS (PARTITION BY t)""",
        "op11_decontamination": oracles.DECONTAMINATION,
        "op12_merkle": oracles.MERKLE,
        "op13_repair": oracles.REPAIR,
    }
