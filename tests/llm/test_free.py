"""Chat, packed ids, packing, SimHash and toxicity against plain versions, and the pipeline."""

import collections
import hashlib
import io
import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from brute import components, fingerprint, sha
from messy_rows import messy_rows
from pyspark.sql import functions as F

from factorloom.llm import chat, components as stars, near_copies, packed_ids, packing, simhash, tokens, toxicity
from factorloom.session import settle

tokenizers = pytest.importorskip("public_tokenizers")
PATH = str(tokenizers.path("byte_bpe_50k.json"))


def test_pieces_encode_like_the_whole():
    coder = tokens.Encoder(PATH)
    texts = [t or "" for _, t in messy_rows() if len(t or "") < 5000] + ["a  b\n\n c\t", "it's we'll I'M", "x<|endoftext|>y", "  ", " x  y"]
    for text, ids in zip(texts, coder.encode_batch(texts), strict=True):
        assert ids.tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids
        assert coder.decode(ids) == text


@pytest.mark.parametrize("text", ["", "\\", "<s>", "a<s>\\b</s>", "\\<s>", "<\\s>", "<<SYS>>[INST]", "[INST[INST]", "<|turn|><|end|>\\\\", "\\\\<s>\\"])
def test_escape_is_reversible_and_breaks_controls(text):
    broken = chat.escape(text)
    assert chat.unescape(broken) == text and not any(c in broken for c in chat.CONTROLS)


def test_escape_on_random_texts():
    rng = random.Random(2)
    parts = list(chat.CONTROLS) + ["\\", "<", ">", "s>", "[", "INST]", "x", "|"]
    for _ in range(2000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 12)))
        assert chat.unescape(chat.escape(text)) == text and not any(c in chat.escape(text) for c in chat.CONTROLS)


def turns(spark):
    rows = [(1, 0, "system", "be <s> brief"), (1, 1, "user", None), (1, 2, "assistant", "ok\\ [INST]"), (1, 3, "assistant", "é😀"),
            (2, 0, "user", "x"), (2, 0, "user", "x"), (None, 1, None, "who"), (None, None, "assistant", ""), (3, 5, "assistant", "long " * 20_000)]
    rows += [(4, i, "assistant" if i % 2 else "user", f"turn {i} </s>") for i in range(500)]
    return rows, spark.createDataFrame([(*r, "mine") for r in rows], "conv_id long, turn long, role string, text string, ids string")


def test_chat_reads_back(spark):
    rows, df = turns(spark)
    got = {r.conv_id: r for r in chat.read_back(chat.written(chat.format_turns(df, PATH)), PATH).collect()}
    groups = collections.defaultdict(list)
    for c, t, role, text in rows:
        groups[c].append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(groups)
    for c, said in groups.items():
        said.sort()
        learned = "".join(x for _, _, role, x in said if role == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(said), sha("".join(f"{role}\n{x}\n" for _, _, role, x in said)))
        assert (r.loss_chars, r.loss_sha256) == (len(learned), sha(learned))
    assert chat.read_back(chat.written(chat.format_turns(df.limit(0), PATH)), PATH).count() == 0


def test_assembled_mask_covers_the_learned_text(spark):
    _, df = turns(spark)
    coder = tokens.Encoder(PATH)
    r = chat.assemble(chat.format_turns(df.where("conv_id = 1"), PATH)).first()
    learned = [i for i, m in zip(r.input_ids, r.loss_mask, strict=True) if m]
    assert coder.decode(learned) == chat.escape("ok\\ [INST]") + "é😀"


@pytest.mark.parametrize("width", [1, 3, 8, 13, 16, 17, 32])
def test_bits_round_trip(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1000, dtype=np.uint64).astype(np.uint32)
    data = packed_ids.pack_bits(ids, width)
    assert len(data) == 125 * width and (packed_ids.unpack_bits(data, width, 1000) == ids).all()


class Source(io.BytesIO):
    def size(self):
        return len(self.getbuffer())

    def read_at(self, n, at):
        return bytes(self.getbuffer()[at : at + n])


def test_file_gives_random_access():
    class Sink(io.BytesIO):
        def close(self):
            self.done = self.getvalue()

    rng, sink = np.random.default_rng(4), Sink()
    docs = [rng.integers(0, 1 << 13, n, dtype=np.uint32) for n in (0, 5, 8, 100, 64, 1, 3000, 0)]
    writer = packed_ids.Writer(sink, 13, block_ids=64)
    for k, ids in enumerate(docs):
        writer.add(None if k == 2 else k - 3, ids)
    writer.close()
    file, whole = packed_ids.Reader(Source(sink.done)), np.concatenate(docs)
    for a, b in itertools.product(range(0, len(whole), 97), range(0, len(whole), 101)):
        assert (file.ids(a, b) == whole[a:b]).all()
    assert all((file.document(k) == ids).all() for k, ids in enumerate(docs))
    assert file.null.tolist() == [k == 2 for k in range(8)] and file.doc_ids[0] == -3
    empty = Sink()
    packed_ids.Writer(empty, 16).close()
    assert packed_ids.Reader(Source(empty.done)).n_ids == 0


def test_packed_ids_round_trip(messy, nothing):
    rows = packed_ids.read_documents(packed_ids.write_ids(messy, PATH, file_bytes=1 << 16)).orderBy("start").collect()
    coder = tokens.Encoder(PATH)
    want = collections.Counter()
    for k, t in messy_rows():
        ids = np.append(coder.encode_batch([t or ""])[0], 0).astype("<u4")
        want[k, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want
    order = [(r.doc_id is not None, r.doc_id or 0) for r in rows]
    assert order == sorted(order)
    assert [r.start for r in rows] == list(itertools.accumulate([0] + [r.n_tokens for r in rows[:-1]]))
    assert packed_ids.read_documents(packed_ids.write_ids(nothing, PATH)).count() == 0


def test_bounds_are_optimal():
    rng = random.Random(6)
    for _ in range(30):
        histogram = {x: rng.randint(1, 9) for x in rng.sample(range(1, 40), rng.randint(1, 9))}
        lengths, k = sorted(histogram), rng.randint(1, 4)
        cost = lambda bounds: sum(n * (min(b for b in bounds if b >= x) - x) for x, n in histogram.items())
        best = min(cost((*c, lengths[-1])) for m in range(min(k, len(lengths))) for c in itertools.combinations(lengths[:-1], m))
        bounds = packing.best_bounds(histogram, k)
        assert len(bounds) <= k and cost(bounds) == best
    assert packing.best_bounds({}, 3) == []


def test_packing_keeps_every_token(messy, nothing):
    rows = packing.pack(messy, max_tokens=256, buckets=5, batch_tokens=1024, part_rows=16).collect()
    length = dict(messy.select("text", packing.token_count(F.coalesce("text", F.lit("")))).collect())
    want = collections.Counter()
    for k, t in messy_rows():
        n = length[t]
        want.update((k, p, min(256, n - 256 * p)) for p in range(-(-n // 256)))
    assert collections.Counter(x for r in rows for x in zip(r.doc_ids, r.pieces, r.lengths, strict=True)) == want
    by_bucket = collections.defaultdict(list)
    for r in rows:
        assert r.n_sequences * r.bound <= 1024 and max(r.lengths) <= r.bound
        assert (r.n_tokens, r.n_padding) == (sum(r.lengths), r.n_sequences * r.bound - sum(r.lengths))
        by_bucket[r.bucket].append(r)
    for group in by_bucket.values():
        assert sum(r.n_sequences < 1024 // r.bound for r in group) <= 1 and sorted(r.batch for r in group) == list(range(len(group)))
    assert packing.pack(nothing).count() == 0


def test_fingerprints_equal_brute_force():
    for _, text in messy_rows():
        if len(text or "") < 20_000:
            assert simhash.fingerprint(text) & (2**64 - 1) == fingerprint(text)


def clustered_codes(n, seed):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(max(1, n // 40))]
    out = set()
    while len(out) < n:
        x = rng.choice(centres)
        for _ in range(rng.randint(0, 6)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


def test_tree_search_finds_every_pair():
    rng = random.Random(3)
    codes, runs = [], []
    for run, size in enumerate([1, 2, 9, 70, 400, 1, 65]):
        own = clustered_codes(size, run)
        own.sort(key=lambda c: int.from_bytes(_gray(c).to_bytes(8, "big"), "big"))
        codes += own
        runs += [run] * size
    a, b = simhash.linked_pairs(np.array(codes, np.uint64), np.array(runs), budget=rng.choice([50, 5000]))
    want = {(i, j) for j in range(len(codes)) for i in range(j) if runs[i] == runs[j] and (codes[i] ^ codes[j]).bit_count() <= 2}
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want


def _gray(c):
    for s in (1, 2, 4, 8, 16, 32):
        c ^= c >> s
    return c


def test_batches_may_cut_runs(monkeypatch):
    monkeypatch.setattr(simhash, "SEARCH_ROWS", 1)
    codes = np.array([1, 3, 7, 8, 9, 1 << 40, 5, 4], np.uint64).view(np.int64)
    table = {"root": pa.array([0, 0, 0, 1, 1, 1, 2, 2], pa.int32()), "head": pa.array([5, 5, 5, 5, 5, 6, 6, 6], pa.int64()), "fp": pa.array(codes)}
    whole = pa.record_batch(table)
    pieces = [whole.slice(i, n) for i, n in ((0, 1), (1, 3), (4, 1), (5, 3))]
    edges = lambda bs: sorted((u, v) for b in simhash._search_runs(iter(bs)) for u, v in zip(b["u"].to_pylist(), b["v"].to_pylist(), strict=True))
    assert edges(pieces) == edges([whole]) == [(3, 1), (4, 5), (7, 1), (9, 8)]


@pytest.mark.parametrize("root_codes", [2, 1024])
def test_links_connect_what_brute_force_connects(spark, root_codes):
    """Small roots are searched in the tree, larger ones joined by shared variants; both are exact."""
    codes = clustered_codes(700, 11)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    df = settle(spark.createDataFrame([(c,) for c in signed], "fp long").repartition(3))
    roots = {r.u: r.v for r in stars.connected_components(simhash.link_codes(df, root_codes)).collect()}
    got, want = collections.defaultdict(set), collections.defaultdict(set)
    for c, s, k in zip(codes, signed, components(codes), strict=True):
        got[roots.get(s, s)].add(c)
        want[k].add(c)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    got = dict(stars.connected_components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 50)}
    assert stars.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_copies(messy, nothing):
    printed = settle(simhash.with_fingerprints(messy))
    out = simhash.group_near_copies(printed).collect()
    rows = [(r.doc_id, r.fingerprint & (2**64 - 1)) for r in out]
    codes = sorted({c for _, c in rows})
    label = dict(zip(codes, components(codes), strict=True))
    ids, kept = collections.defaultdict(list), collections.Counter()
    for k, c in rows:
        ids[label[c]].append(k)
    for r, (k, c) in zip(out, rows, strict=True):
        known = [i for i in ids[label[c]] if i is not None]
        assert r.component_id == (min(known) if known else None)
        kept[label[c]] += r.kept
    assert set(kept.values()) == {1}
    left = simhash.drop_near_copies(messy)
    assert left.columns == messy.columns and left.count() == len(kept)
    assert simhash.drop_near_copies(nothing).count() == 0


def test_edited_copies_are_dropped(spark):
    import corpus_pipeline

    rng = random.Random(6)
    words = lambda n: ["".join(rng.choice("abdefghilmnorstu") for _ in range(5)) for _ in range(n)]
    texts = []
    for i in range(40):
        text = words(200)
        texts.append(text)
        if i % 2:  # three words far apart changed: 15 of 196 shingles, similarity 181 / 211
            texts.append([w + "x" * (k in (20, 90, 160)) for k, w in enumerate(text)])
        else:  # five of them: 25 of 196, similarity 171 / 221, no copy
            texts.append([w + "x" * (k in (20, 55, 90, 125, 160)) for k, w in enumerate(text)])
    base = words(60)  # a large group, more than a block: each text resembles the base only
    texts += [base] + [[*base[:k], w, *base[k:]] for k in range(8, 52) for w in words(10)]
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if label[i] != label[j] and len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    left = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(label)) and len(set(label)) == 61


def test_no_link_is_lost_in_a_large_group(spark):
    rng = random.Random(12)
    words = lambda n: ["".join(rng.choice("abdefghilmnorstu") for _ in range(6)) for _ in range(n)]
    passage, rows = words(170), []
    for _ in range(600):  # the passage is 166 of 196 shingles: any two texts have similarity 0.735, the two of a pair 0.81 or more
        own = words(30)
        other = [*own[:7], *words(16), *own[23:]]
        rows += [" ".join(own + passage), " ".join(other + passage)]
    sets = [set(near_copies.shingle_set(t).tolist()) for t in rows]
    likeness = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert min(likeness(i, i + 1) for i in range(0, 1200, 2)) >= 0.8 > max(likeness(i, j) for i in range(0, 60, 2) for j in range(i + 2, 1200))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in near_copies.drop_near_copies(docs).collect()) == list(range(0, 1200, 2))


def test_fingerprints_bring_near_copies_together(spark, monkeypatch):
    rng = random.Random(21)
    words = lambda n: ["".join(rng.choice("abdefghilmnorstu") for _ in range(6)) for _ in range(n)]
    rows = []
    for _ in range(6):  # one word of 600 changed at the end: similarity over 0.98
        text = words(600)
        rows += [" ".join(text), " ".join([*text[:-1], "changed"])]
    block = words(31) * 50  # the same repeated block before other words: almost equal fingerprints, similarity under 0.3
    rows += [" ".join(block + words(60)), " ".join(block + words(60))]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    codes = [simhash.fingerprint(t) & (2**64 - 1) for t in rows]
    within = [(i, i + 1) for i in range(0, 14, 2) if (codes[i] ^ codes[i + 1]).bit_count() <= 2]
    assert (12, 13) in within and len(within) > 3
    sets = [near_copies.shingle_set(t) for t in rows]
    names = {xxhash.xxh64_intdigest(s.tobytes()): i for i, s in enumerate(sets)}
    printed = simhash.with_fingerprints(near_copies.with_sketches(docs, "text", "sketch"), "text", "code")
    # without any band the index alone brings texts together, and the exact check decides
    bare = settle(printed.withColumn("sketch", F.col("sketch").withField("keys", F.array().cast("array<long>"))))
    got = {tuple(sorted(names[x & (2**64 - 1)] for x in r)) for r in near_copies.link_texts(bare, "text", "sketch", fingerprint="code").collect()}
    assert got == set(within) - {(12, 13)}
    assert near_copies.link_texts(bare, "text", "sketch").count() == 0
    # the stage links the fingerprints of all its texts
    seen, link = [], near_copies.link_codes
    monkeypatch.setattr(near_copies, "link_codes", lambda c: seen.append({r.fp & (2**64 - 1) for r in c.collect()}) or link(c))
    left = near_copies.drop_near_copies(docs)
    assert sorted(r.doc_id for r in left.collect()) == [0, 2, 4, 6, 8, 10, 12, 13] and left.columns == ["doc_id", "text"]
    assert seen == [set(codes)]


def toxic_corpus(spark, n=1500):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abdefghilmnorstu") for _ in range(rng.randint(3, 8))) for _ in range(800)]
    insults = ["idiot", "scumbag", "moron", "loser", "zugrok", "zugrim", "zugrax"]
    rows = []
    for i in range(n):
        bad = rng.random() < 0.2
        words = rng.choices(vocabulary, k=rng.randint(8, 150))
        for _ in range(rng.randint(1, 4) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(insults).upper() if rng.random() < 0.2 else rng.choice(insults))
        rows.append((i, " ".join(words) + ".", int(bad)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"), {r[0]: r[2] for r in rows}


def test_toxicity_on_held_out_rows(spark):
    docs, marks, truth = toxic_corpus(spark)
    rows = toxicity.score_toxicity(docs, marks).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out]
    assert sum(p == t for p, t in held) > 0.97 * len(held)
    assert sum(p for p, t in held if t) > 0.9 * sum(t for _, t in held)


def test_held_out_labels_do_not_matter(spark):
    docs, marks, _ = toxic_corpus(spark, 400)
    flipped = marks.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = lambda m: dict(toxicity.score_toxicity(docs, m).select("doc_id", "score").collect())
    a, b = scores(marks), scores(flipped)
    assert all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_voters_that_copy_each_other_count_once():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.2
    own = [np.where(truth, rng.random(4000) < 0.7, rng.random(4000) < 0.05) for _ in range(3)]
    votes = np.stack([own[0], own[0], own[0], own[1], own[2]], 1).astype(np.int8)
    post, odds, damp, corr = toxicity.fit_label_model(votes, truth.astype(int))
    assert (corr[:3, :3] > 0.9).all() and corr[3, 4] < 0.3 and abs(damp[0] - 1 / 3) < 0.05 and damp[3] > 0.9
    assert (odds > 2).all() and ((post > 0.5) == truth).mean() > 0.85  # abstaining is no evidence, so odds run high


def test_texts_with_one_beginning_all_count(spark):
    rng = random.Random(4)
    opening = "Posted by a reader of the evening edition on the second page: "
    words = lambda n: " ".join("".join(rng.choice("abdefghilmnorstu") for _ in range(6)) for _ in range(n))
    toxic = [opening + words(40) + " zugrok" for _ in range(30)]
    clean = [opening + words(40) for _ in range(200)]
    copies = [toxic[0] + " " + words(1), toxic[0].upper(), clean[0] + " end", clean[0]]
    rows = [(1, t) for t in toxic + copies[:2]] + [(0, t) for t in clean + copies[2:]]
    told = toxicity.count_once(spark.createDataFrame(rows, "toxic int, text string")).groupBy("toxic").count().collect()
    assert dict(told) == {1: 30, 0: 200}
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, m) for i, (m, _) in enumerate(rows)], "doc_id long, toxic int")
    assert "0zugrok" in toxicity.fit(docs, marks).entries


def test_toxicity_of_messy_rows(messy, nothing, labels):
    rows = toxicity.score_toxicity(messy, labels).collect()
    assert len(rows) == len(messy_rows()) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score_toxicity(messy, labels.where("toxic > 3")).where("predicted = 1").count() == 0
    assert toxicity.score_toxicity(nothing, labels).count() == 0
    out = toxicity.drop_toxic(messy, labels)
    assert out.columns == messy.columns


def test_pipeline_against_plain_stages(spark, messy, labels, tmp_path):
    import corpus_pipeline

    messy.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before = collections.Counter((r.doc_id, r.text) for r in docs.collect()) if name != "packing" else None
        columns = docs.columns
        last = docs
        docs = settle(stage(spark, docs, str(tmp_path)))
        if name == "packing":
            packed = collections.Counter(d for r in docs.collect() for d, p in zip(r.doc_ids, r.pieces, strict=True) if p == 0)
            assert packed == collections.Counter(r.doc_id for r in last.collect())
            break
        assert docs.columns == columns
        after = collections.Counter((r.doc_id, r.text) for r in docs.collect())
        assert set(after) <= set(before)
        low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        if name == "exact_dedup":
            assert collections.Counter(low(t) for _, t in after.elements()) == collections.Counter({low(t) for _, t in before})
        if name == "near_dedup":
            codes = sorted({simhash.fingerprint(t) & (2**64 - 1) for _, t in before})
            label = dict(zip(codes, components(codes), strict=True))
            assert sorted(label[simhash.fingerprint(t) & (2**64 - 1)] for _, t in after.elements()) == sorted(set(label.values()))
        if name == "mixing":
            assert set(after) == set(before)
        seen.append(name)
    assert seen == ["toxicity", "exact_dedup", "near_dedup", "mixing"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_sha_helper():
    assert sha("a") == hashlib.sha256(b"a").hexdigest()
