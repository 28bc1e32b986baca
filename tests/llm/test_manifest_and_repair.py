"""Decontamination, the Merkle manifest and conversation repair against plain versions."""

import collections
import hashlib
import itertools
import random
import re

import pytest
from brute import sha
from messy_rows import messy_rows
from pyspark.sql import functions as F

from factorloom.llm import decontaminate, merkle, queries, repair

FOLD = {**{c: c + 32 for c in range(65, 91)}}


# ------------------------------------------------------------------------------ decontamination


def cut(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def leaks(text, items, width):
    """(n_words, hit places, items) of a text, by comparing every window with every place."""
    w, places, found = cut(text), set(), set()
    for item_id, item in items:
        v = cut(item)
        n = min(width, len(v))
        for s in range(len(v) - n + 1) if v else ():
            for p in range(len(w) - n + 1):
                if w[p : p + n] == v[s : s + n]:
                    places |= set(range(p, p + n))
                    found.add("" if item_id is None else str(item_id))
    return len(w), places, sorted(found)


@pytest.fixture(scope="session")
def items():
    texts = dict(enumerate(t for _, t in messy_rows()[:12]))
    return [(0, texts[3]), (1, texts[3]), (10, texts[5].upper() + "!"), (2, "TWO, words"), (3, None), (4, " .. "), (None, texts[7]), (5, "É é"),
            (6, "copy of one"), (6, "hot hot hot"), (9, "x y z w v x y z w v x y z"), (9, "x y z w v x y z w v x y z")]


@pytest.mark.parametrize(("width", "block_pairs"), [(10, 250_000), (4, 30)])
def test_decontamination_equals_brute_force(spark, messy, items, width, block_pairs):
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.find_contamination(messy, bench, width=width, block_pairs=block_pairs).collect()
    assert collections.Counter((r.doc_id, r.text) for r in rows) == collections.Counter(messy_rows())
    known = {}
    for r in rows:
        if r.text not in known:
            known[r.text] = leaks(r.text, items, width)
        n, places, found = known[r.text]
        hit = {p for a, b in r.hit_runs for p in range(a, b)}
        assert (r.n_words, hit, r.n_hit, r.items, r.contaminated) == (n, places, len(places), found, bool(places))
    assert sum(r.contaminated for r in rows) > 80


def test_only_whole_windows_count(spark):
    item = " ".join(f"w{i}" for i in range(30))
    docs = [(1, "a " + " ".join(f"W{i}" for i in range(5, 15)) + " b"), (2, " ".join(f"w{i}" for i in range(9))), (3, item.replace("w7 ", "")), (4, "W1-w2")]
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert [got[k].n_hit for k in (1, 2, 3, 4)] == [10, 0, 22, 0]
    assert got[1].hit_runs == [[1, 11]] and got[3].hit_runs == [[7, 29]]


def test_equal_hashes_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "hashes", lambda ids, n: __import__("numpy").zeros(len(ids) - n + 1, "uint64"))
    block = decontaminate.Block([("a b", "1"), ("c d", "2"), ("b c", "3")])
    ids = [block.numbers.get(w, 0) for w in (b"a", b"b", b"d", b"c", b"d")]
    np = __import__("numpy")
    assert sorted(block.hits(np.array(ids, np.uint64), np.arange(5, 0, -1))) == [(0, 2, ["1"]), (3, 2, ["2"])]


def test_spans_and_documents_are_removed(spark, messy, nothing):
    bench = spark.createDataFrame([(1, "the quick, brown fox"), (2, "z")], "item_id long, text string")
    texts = ["Say: THE QUICK brown fox jumps. Z!", "the quick brown", None, "z", "é z é"]
    docs = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)], "doc_id long, text string, N_words string")
    out = decontaminate.remove_contamination(docs, bench)
    assert out.columns == docs.columns
    assert [tuple(r) for r in out.orderBy("doc_id").collect()] == [
        (0, "Say:  jumps. !", "mine"), (1, "the quick brown", "mine"), (2, None, "mine"), (3, "", "mine"), (4, "é  é", "mine")]
    share = decontaminate.remove_contamination(docs, bench, drop_share=0.5)
    assert [r.doc_id for r in share.orderBy("doc_id").collect()] == [1, 2, 4]
    every = decontaminate.remove_contamination(docs, bench, drop_share=0)
    assert [r.doc_id for r in every.orderBy("doc_id").collect()] == [1, 2]
    assert decontaminate.remove_contamination(nothing, bench).count() == 0
    assert decontaminate.remove_contamination(messy, bench.limit(0)).count() == len(messy_rows())


# ------------------------------------------------------------------------------ manifest


def leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes, arity):
    """(root, proofs) of a list of digests."""
    ways, spans = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, wider = [], []
        for s in range(0, len(nodes), arity):
            run = nodes[s : s + arity]
            for k in range(len(run)):
                for i in spans[s + k]:
                    ways[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(sha("".join(run)))
            wider.append([i for x in spans[s : s + arity] for i in x])
        nodes, spans = up, wider
    return nodes[0], ways


@pytest.mark.parametrize(("arity", "block"), [(2, 1024), (2, 4), (3, 9), (2, 2)])
def test_manifest_equals_plain_trees(messy, arity, block):
    fields = ["doc_id", "lang", "text"]
    groups = collections.defaultdict(list)
    for r in messy.collect():
        groups[r.lang].append((r.doc_id is not None, r.doc_id or 0, leaf([r.doc_id, r.lang, r.text])))
    want, subroots = [], []
    for lang in sorted(groups, key=lambda x: (x is not None, x or "")):
        rows = sorted(groups[lang])
        sub, ways = plain_tree([x for *_, x in rows], arity)
        subroots.append(sub)
        want += [[a and b if a else None, x, sub, way, len(subroots) - 1] for (a, b, x), way in zip(rows, ways, strict=True)]
    root, over = plain_tree(subroots, arity)
    expected = collections.Counter((x[1], x[2], root, tuple(x[3] + over[x[4]])) for x in want)
    out = merkle.manifest(messy, fields, "lang", "doc_id", arity=arity, block=block)
    rows = out.withColumn("folded", merkle.fold(F.col("leaf"), F.col("proof"))).collect()
    assert collections.Counter((r.leaf, r.subroot, r.root, tuple((s.left, s.right) for s in r.proof)) for r in rows) == expected
    assert all(r.folded == root for r in rows)


def test_one_leaf_is_its_own_root_and_none_has_none(spark, nothing):
    one = merkle.manifest(spark.createDataFrame([(4, None)], "doc_id long, lang string"), ["doc_id"], "lang", "doc_id").first()
    assert one.leaf == one.subroot == one.root == sha("1:4") and one.proof == []
    assert merkle.manifest(nothing, ["doc_id"], "lang", "doc_id").count() == 0


def test_manifest_finds_what_changed(spark):
    rows = [(i, f"t{i}", "en" if i % 3 else None) for i in range(50)]
    listed = merkle.manifest(spark.createDataFrame(rows, "doc_id long, text string, lang string"), ["doc_id", "text"], "lang", "doc_id", block=8)
    later = [r for r in rows if r[0] != 7] + [(99, "new", "en")]
    later[3] = (3, "other", None)
    now = spark.createDataFrame(later, "doc_id long, text string, lang string")
    status = {r.doc_id: r.status for r in merkle.verify(listed, now, ["doc_id", "text"], "doc_id").collect()}
    assert {k: v for k, v in status.items() if v != "same"} == {"3": "changed", "7": "missing", "99": "new"} and len(status) == 51


def test_tampered_rows_alone_fail(spark):
    rows = queries.op12_merkle(spark, "/root/testdata/sf0.001").collect()
    import zlib

    docs = {r.doc_id: r.n_chars for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in rows:
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0 or docs[r.doc_id] is None)


# ------------------------------------------------------------------------------ conversation repair


def class_of(rows):
    out, seen = [], set()
    for role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_repair(rows):
    """(cost, letters, lines) by trying every choice with up to two insertions before each turn and at the end."""
    faults, best = class_of(rows), None
    gaps = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    keep = [[("D", 3, None)] + ([] if f in ("blank", "duplicate") else
             [(e, c + (f == "truncated"), x) for e, c, x in (("K", 0, r), ("R", 2, "user"), ("R", 2, "assistant"))])
            for (r, _), f in zip(rows, faults, strict=True)]
    for choice in itertools.product(*itertools.chain.from_iterable((gaps, k) for k in keep), gaps):
        cost, letters, lines = 0, "", []
        for k, c in enumerate(choice):
            if k % 2 == 0:
                cost, letters = cost + 2 * len(c), letters + "I" * len(c)
                lines += [f"{r}:" for r in c]
            else:
                cost, letters = cost + c[1], letters + c[0]
                lines += [f"{c[2]}:{rows[k // 2][1]}"] if c[0] != "D" else []
        if re.fullmatch(r"(s?(ua)+)?", "".join(x[0] for x in lines)) and (best is None or (cost, letters) < best[:2]):
            best = cost, letters, lines
    return best


def random_rows(rng, n):
    return [(rng.choice(["user", "assistant", "assistant", "user", "system", " ", "tool"]), rng.choice(["Yes.", "No!", "cut off", " \t", "ok? ", f"{rng.random()}."])) for _ in range(n)]


def test_repair_equals_trying_everything(spark):
    rng = random.Random(11)
    talks = [random_rows(rng, rng.randint(1, 3)) for _ in range(60)]
    df = spark.createDataFrame([(c, 2 * t, *row) for c, talk in enumerate(talks) for t, row in enumerate(talk)], "conv_id long, turn long, role string, text string")
    mended = repair.repair_conversations(df)
    reports = {r.conv_id: r for r in mended.reports.collect()}
    digests = {r.key: r for r in repair.digests(mended).collect()}
    lines = collections.defaultdict(list)
    for r in mended.turns().orderBy("step").collect():
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    for c, talk in enumerate(talks):
        cost, letters, want = plain_repair(talk)
        r, faults = reports[c], collections.Counter(class_of(talk))
        initials = [role[0] for role, _ in talk]
        assert (r.cost, digests[f"={c}"].audit, lines[c]) == (cost, letters, want), talk
        assert digests[f"={c}"].repaired_sha256 == hashlib.sha256("\n".join(want).encode()).hexdigest()
        assert (r.blank, r.duplicate, r.truncated, r.gaps) == (faults["blank"], faults["duplicate"], faults["truncated"], len(talk) - 1)
        assert r.illegal == sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


@pytest.mark.parametrize(("chunk", "fan"), [(1, 2), (3, 2), (4, 256)])
def test_chunks_give_what_one_weight_gives(spark, chunk, fan):
    rng = random.Random(chunk)
    rows = [(c, t, *row) for c, n in ((1, 1), (2, 40), (3, 3), (None, 17)) for t, row in enumerate(random_rows(rng, n))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    parts, whole = repair.repair_conversations(df, chunk=chunk, fan=fan), repair.repair_conversations(df)
    both = [{r.key: tuple(r) for r in repair.digests(x).collect()} for x in (parts, whole)]
    assert both[0] == both[1] and len(both[0]) == 4
    assert [sorted(map(str, x.reports.collect())) for x in (parts, whole)][0] == sorted(map(str, whole.reports.collect()))


def test_repair_of_nulls_ties_and_nothing(spark):
    schema = "conv_id long, turn long, role string, text string, cost string, edit string"
    rows = [(None, 1, "user", "Hi.", "mine", "mine"), (None, 1, "assistant", "Yes.", "mine", "mine"), (5, None, "assistant", "B.", None, None),
            (5, None, "user", "A.", None, None), (6, 3, None, None, None, None), (7, 0, "user", "long " * 50_000 + ".", None, None)]
    mended = repair.repair_conversations(spark.createDataFrame(rows, schema))
    audits = {r.key: r.audit for r in repair.digests(mended).collect()}
    # Rows of one turn go by role, so the assistant comes first.
    assert audits == {"-": "IKKI", "=5": "IKKI", "=6": "D", "=7": "KI"}
    reports = {r.key: r for r in mended.reports.collect()}
    assert reports["=6"].blank == 1 and reports["=5"].gaps == 0 and reports["-"].illegal == 0 and reports["-"].conv_id is None
    none = repair.repair_conversations(spark.createDataFrame([], schema))
    assert none.reports.count() == none.edits.count() == repair.digests(none).count() == 0
