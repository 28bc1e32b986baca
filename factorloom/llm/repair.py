"""Conversation repair: the cheapest edits that make roles alternate, by integer-minimum dynamic programming.

A path of edits has one integer weight. Its high digits are the cost; below them every edit's letter
has a digit of fixed width, first edit first, zeros after the last. The least integer is so the
cheapest path and, among equal costs, the one with the ASCII-least letters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from factorloom.llm.places import key_of, with_places
from factorloom.llm.text import ready_for_python
from factorloom.session import settle

# The characters that don't fill a text, the marks that end one, the letters and costs of edits.
BLANKS = " \t\n\x0b\x0c\r"
ENDINGS = (".", "!", "?")
LETTERS = " DIKR"
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
COSTS = {DELETE: 3, INSERT: 2, KEEP: 0, REROLE: 2}
#: Turns whose weights are one integer; longer conversations are cut into chunks of as many.
CHUNK = 1024
#: Chunks (or groups of them) that are summed up in one row.
FAN = 256
DIGIT = 3  # bits
FAR = 1 << 40  # a cost that no path has

# What the repaired roles end with so far: nothing, the system turn, a user, an assistant.
STATES = EMPTY, SYSTEM, USER, ASSISTANT = range(4)
ROLES = "sua?"
NEXT = (USER, USER, ASSISTANT, USER)  # an inserted or renamed turn is what the pattern asks for
FREE, SHORT, DROP = range(3)  # a turn's fault class: none, truncated, blank or duplicate
NAMES = {USER: "user", ASSISTANT: "assistant"}


def sign(role: Column, fault: Column) -> Column:
    """One letter for a turn: place of its role's initial in ROLES, and fault class."""
    initial = F.substring(role, 1, 1)
    place = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return F.char((place * 3 + fault + 65).cast("long"))


def read_sign(letter: str) -> tuple[str, int]:
    role, fault = divmod(ord(letter) - 65, 3)
    return ROLES[role], fault


def kept_state(state: int, role: str) -> int | None:
    """Where a turn of this role leads, None if it may not follow."""
    if role == "s":
        return SYSTEM if state == EMPTY else None
    if role == "u":
        return USER if state != USER else None
    return ASSISTANT if role == "a" and state == USER else None


def edits_of(state: int, letter: str) -> list[tuple[int, int, int]]:
    """(edit, cost, next state) of all that may be done with a turn."""
    role, fault = read_sign(letter)
    out = [(DELETE, COSTS[DELETE], state)]
    if fault != DROP:
        extra, to = int(fault == SHORT), kept_state(state, role)
        out.append((REROLE, COSTS[REROLE] + extra, NEXT[state]))
        if to is not None:
            out.append((KEEP, COSTS[KEEP] + extra, to))
    return out


def solve(signs: str, ends: tuple[int, ...] | None) -> tuple[int, list[int]]:
    """Digits of a weight, and the least weight from each state before the first turn.

    ``ends`` are the costs of what follows the last turn, by state; None: nothing follows, so the
    conversation must be empty or end with an assistant, if need be by insertions. Insertions
    stand before the turn that follows them, so paths of a chunk end with a turn, none is the
    beginning of another, and the chunk's letters settle ties whatever follows.
    """
    digits = 3 * len(signs) + 2
    high, top = DIGIT * digits, DIGIT * (digits - 1)
    low = (1 << high) - 1

    def before(edit: int, cost: int, weight: int) -> int:
        return (((weight >> high) + cost) << high) | (edit << top) | ((weight & low) >> DIGIT)

    def inserted(weight: int) -> int:
        return before(INSERT, COSTS[INSERT], weight)

    if ends is None:
        after = [0, inserted(inserted(0)), inserted(0), 0]
    else:
        after = [cost << high for cost in ends]
    for letter in reversed(signs):
        turn = [min(before(e, c, after[to]) for e, c, to in edits_of(s, letter)) for s in STATES]
        first = [min(turn[s], inserted(turn[NEXT[s]])) for s in STATES]  # one insertion at most
        two = inserted(inserted(turn[ASSISTANT]))
        after = [min(first[EMPTY], two), min(first[SYSTEM], two), first[USER], first[ASSISTANT]]
    return digits, after


def letters_of(weight: int, digits: int) -> list[int]:
    """The edits that a weight's low digits name."""
    out = []
    for k in range(digits - 1, -1, -1):
        edit = weight >> (DIGIT * k) & ((1 << DIGIT) - 1)
        if not edit:
            break
        out.append(edit)
    return out


@lru_cache(maxsize=1 << 14)
def repaired(signs: str, ends: tuple[int, ...] | None, state: int) -> tuple[list[int], list[int], list[int], int, int]:
    """Edits, their turns (-1: inserted), states after them, cost and last state of the best path from ``state``."""
    digits, weights = solve(signs, ends)
    edits, turns, states, cost, at = letters_of(weights[state], digits), [], [], 0, 0
    for edit in edits:
        if edit == INSERT:
            turns.append(-1)
            state, cost = NEXT[state], cost + COSTS[INSERT]
        else:
            _, more, state = next(x for x in edits_of(state, signs[at]) if x[0] == edit)
            turns.append(at)
            at, cost = at + 1, cost + more
        states.append(state)
    return edits, turns, states, cost, state


def costs_between(signs: str) -> list[int]:
    """Least cost from each state before a chunk to each state after its last turn, row by row."""
    columns = []
    for target in STATES:
        digits, weights = solve(signs, tuple(0 if s == target else FAR for s in STATES))
        columns.append([min(FAR, w >> DIGIT * digits) for w in weights])
    return [columns[t][s] for s in STATES for t in STATES]


def costs_before(matrix: list[int], ends: list[int]) -> list[int]:
    """Costs to the end before a chunk, from those after it."""
    return [min(matrix[4 * s + t] + ends[t] for t in STATES) for s in STATES]


def joined_costs(matrices: list[list[int]]) -> list[int]:
    out = matrices[0]
    for m in matrices[1:]:
        out = [min(FAR, min(out[4 * s + k] + m[4 * k + t] for k in STATES)) for s in STATES for t in STATES]
    return out


def ends_of_each(matrices: list[list[int]], ends: list[int]) -> list[list[int]]:
    """Costs that follow each chunk, from those that follow the last."""
    out = [ends]
    for m in reversed(matrices[1:]):
        out.append(costs_before(m, out[-1]))
    return out[::-1]


def joined_moves(moves: list[list[int]]) -> list[int]:
    out = list(STATES)
    for m in moves:
        out = [m[s] for s in out]
    return out


def entry_of_each(moves: list[list[int]], entry: list[int]) -> list[list[int]]:
    """State before each chunk, from that before the first."""
    out = [entry]
    for m in moves[:-1]:
        out.append([m[out[-1][0]]])
    return out


def per_row(df: DataFrame, use: Callable[[dict], dict], schema: str) -> DataFrame:
    """``use`` on every row, in Python."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([use(r) for r in batch.to_pylist()], schema=arrow)

    return df.mapInArrow(run, schema)


def sweep(items: DataFrame, join: Callable, each: Callable, outer: list[int], fan: int) -> DataFrame:
    """(key, at, given): what ``each`` hands to every item of its conversation, which as a whole is given ``outer``.

    ``items`` has key, at and item. ``fan`` neighbours are joined to one item of the next round until each
    conversation is a single one; then ``given`` passes down. A row holds ``fan`` items at most.
    """
    rounds, longest = [], items.agg(F.max("at")).first()[0] or 0
    while True:
        members = F.sort_array(F.collect_list(F.struct("at", "item")))
        groups = settle(items.groupBy("key", F.floor(F.col("at") / fan).alias("up")).agg(members.alias("members")), "sweep")
        rounds.append(groups)
        longest //= fan
        if not longest:
            break
        items = per_row(groups, lambda r: {"key": r["key"], "at": r["up"], "item": join([m["item"] for m in r["members"]])},
                        "key string, at long, item array<bigint>")
    given = rounds[-1].select("key", "up", F.array(*[F.lit(x).cast("long") for x in outer]).alias("given"))
    for groups in reversed(rounds):
        told = groups.join(given, ["key", "up"])
        spread = per_row(told, lambda r: {"key": r["key"], "parts": [
            {"at": m["at"], "given": g} for m, g in zip(r["members"], each([m["item"] for m in r["members"]], r["given"]), strict=True)]},
            "key string, parts array<struct<at:bigint,given:array<bigint>>>")
        down = spread.select("key", F.inline("parts"))
        given = down.select("key", F.col("at").alias("up"), "given")
    return settle(down, "given")


@dataclass
class Repair:
    """``edits``: one row an edit with conv_id, step (ascending in a conversation), edit, turn, role and text; role and
    text are the repaired ones, those of deleted turns as they were. ``reports``: one row a conversation. ``key`` names
    the conversation in both, also where conv_id is null."""

    edits: DataFrame
    reports: DataFrame

    def turns(self) -> DataFrame:
        """The repaired conversations."""
        return self.edits.where("edit != 'D'").select("conv_id", "step", "turn", "role", "text")


def repair_conversations(turns: DataFrame, chunk: int = CHUNK, fan: int = FAN) -> Repair:
    """Faults of conversations, and the cheapest edits that mend them.

    ``turns`` has conv_id, turn, role and text; a conversation's rows are taken by turn (nulls first),
    ties by role and text. A row's first fault counts: blank (nothing but white space), duplicate
    (role and text seen earlier), truncated (last visible character not one of ``.!?``). Edits: Keep
    costs 0, Rerole to user or assistant 2, Delete 3 (required for blank and duplicate rows), Insert
    an empty user or assistant turn 2; a truncated row that stays adds 1. The roles' initials must
    read ``(s?(ua)+)?`` in the end. Cheapest edits win, among them those with the ASCII-least letters.

    ``reports``: conv_id, gaps (turn numbers missing between the least and the largest), blank,
    duplicate, truncated, illegal (neighbours whose initials aren't su, ua or au), cost.

    Null conv_ids are one conversation, null roles and texts count as one space, null turns have no
    part in gaps. Repeated rows are duplicates. Texts may be of any length. Other columns are not
    read. An empty table gives none. A conversation may hold any share of the rows: places come from
    ranges, weights cover ``chunk`` turns at most, and costs pass from chunk to chunk in rounds.
    """
    spark = turns.sparkSession
    ready_for_python(spark)
    kind_of_id = turns.schema["conv_id"].dataType
    conv_id = F.when(F.col("key") != "-", F.substr("key", F.lit(2)).cast(kind_of_id)).alias("conv_id")
    plain = turns.select(key_of("conv_id").alias("key"), F.col("turn").cast("long").alias("turn"),
                         *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])
    rows = with_places(plain, "key", ["turn", "role", "text"])
    # Read twice below; the full width once more when edits find their texts.
    shown = F.rtrim(F.col("text"), F.lit(BLANKS))
    same = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)
    narrow = settle(rows.select("key", "turn", "place", "total", "role", (shown == "").alias("blank"), same.alias("same"),
                                F.right(shown, F.lit(1)).isin(*ENDINGS).alias("ended")), "turns")
    firsts = narrow.groupBy("key", "same").agg(F.min("place").alias("place")).select("key", "place", F.lit(True).alias("first"))
    told = narrow.join(firsts, ["key", "place"], "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(~F.col("ended"), "truncated")
    kind = F.when(fault.isin("blank", "duplicate"), DROP).when(fault == "truncated", SHORT).otherwise(FREE)
    signed = told.select("key", "place", "total", fault.alias("fault"), sign(F.col("role"), kind).alias("sign"))
    line = F.array_join(F.sort_array(F.collect_list(F.struct("place", "sign")))["sign"], "")
    counts = [F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated")]
    last = F.floor((F.first("total") - 1) / chunk)
    chunks = signed.groupBy("key", F.floor(F.col("place") / chunk).alias("at")).agg(line.alias("signs"), last.alias("last"), *counts)
    chunks = settle(chunks, "chunks")

    long = chunks.where("last > 0")
    if long.isEmpty():
        known = chunks.select("*", F.lit(None).cast("array<bigint>").alias("ends"), F.lit(0).cast("long").alias("entry"), F.lit("").alias("behind"))
    else:
        matrices = per_row(long.select("key", "at", "signs"), lambda r: {"key": r["key"], "at": r["at"], "item": costs_between(r["signs"])},
                           "key string, at long, item array<bigint>")
        ends = sweep(matrices, joined_costs, ends_of_each, [0, 4, 2, 0], fan).withColumnRenamed("given", "ends")
        moved = per_row(long.join(ends, ["key", "at"]).select("key", "at", "signs", "last", "ends"), _moves, "key string, at long, item array<bigint>")
        entries = sweep(moved, joined_moves, entry_of_each, [EMPTY], fan).select("key", "at", F.get("given", F.lit(0)).alias("entry"))
        behind = long.select("key", (F.col("at") + 1).alias("at"), F.right("signs", F.lit(1)).alias("behind"))
        known = (chunks.join(ends, ["key", "at"], "left").join(entries, ["key", "at"], "left").join(behind, ["key", "at"], "left")
                 .withColumns({"entry": F.coalesce("entry", F.lit(0).cast("long")), "behind": F.coalesce("behind", F.lit(""))}))
    part = "struct<step:bigint,edit:string,place:bigint,role:string>"
    decided = per_row(known.select("key", "at", "signs", "last", "ends", "entry", "behind", "blank", "duplicate", "truncated"), lambda r: _decide(r, chunk),
                      f"key string, blank long, duplicate long, truncated long, illegal long, cost long, edits array<{part}>")
    decided = settle(decided, "decided")
    steps = decided.select("key", F.inline("edits"))
    texts = rows.select("key", "place", "turn", F.col("role").alias("had"), "text")
    gone = F.col("had").isNull()
    edits = steps.join(texts, ["key", "place"], "left").select(
        "key", conv_id, "step", "edit", "turn", F.coalesce("role", "had").alias("role"), F.when(gone, "").otherwise(F.col("text")).alias("text"))
    spans = narrow.groupBy("key").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"))
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    reports = spans.join(decided.groupBy("key").agg(*sums), "key").select("key", conv_id, "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return Repair(edits, reports)


def _ends(r: dict) -> tuple[int, ...] | None:
    return None if r["at"] == r["last"] else tuple(r["ends"])


def _moves(r: dict) -> dict:
    """State after a chunk for each state before it."""
    return {"key": r["key"], "at": r["at"], "item": [repaired(r["signs"], _ends(r), s)[4] for s in STATES]}


def _decide(r: dict, chunk: int) -> dict:
    """A chunk's edits and sums."""
    signs = r["signs"]
    edits, turns, states, cost, _ = repaired(signs, _ends(r), r["entry"])
    out = {k: r[k] for k in ("key", "blank", "duplicate", "truncated")}
    roles = [read_sign(x)[0] for x in r["behind"] + signs]
    pairs = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))
    first = r["at"] * 4 * chunk  # a chunk has fewer edits than that
    steps = [{
        "step": first + k, "edit": LETTERS[e],
        "place": r["at"] * chunk + t if t >= 0 else -1 - first - k,  # no turn has it
        "role": NAMES[s] if e in (INSERT, REROLE) else None} for k, (e, t, s) in enumerate(zip(edits, turns, states, strict=True))]
    return out | {"illegal": pairs, "cost": cost, "edits": steps}


def digests(repair: Repair) -> DataFrame:
    """(key, audit, repaired_sha256): a conversation's edits as letters, and the digest of its repaired ``role:text`` lines.

    SHA-256 is sequential: a conversation streams through one task in order, its texts are not held.
    """
    schema = pa.schema([("key", pa.string()), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, letters, digest, lines = None, [], hashlib.sha256(), 0
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if r["key"] != key:
                    if key is not None:
                        done.append((key, "".join(letters), digest.hexdigest()))
                    key, letters, digest, lines = r["key"], [], hashlib.sha256(), 0
                letters.append(r["edit"])
                if r["edit"] != "D":
                    digest.update(("\n" * (lines > 0) + f"{r['role']}:{r['text']}").encode())
                    lines += 1
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*done, strict=True)], schema=schema)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (key, "".join(letters), digest.hexdigest())], schema=schema)

    ordered = repair.edits.select("key", "step", "edit", "role", "text").repartition("key").sortWithinPartitions("key", "step")
    return ordered.mapInArrow(read, "key string, audit string, repaired_sha256 string")
