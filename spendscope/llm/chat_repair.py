"""Conversation repair: the cheapest edits to alternating roles, by transfer matrices over a grammar of shared patterns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendscope.session import settle

RULES_A_ROUND = 32  # pairs that become rules at once
ROUNDS = 6  # so a rule stands for 64 rows at most
BLOCK_ROWS = 4096  # of one conversation that are read before their symbols leave the task

# Edit costs, the initials of the roles, and the symbols of rows.
RETELL, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3  # another role, a deletion, an empty turn, a truncated row that stays
KEPT = "suax"  # rows without a fault whose role begins with s, u, a or something else
TRUNCATED = "SUAX"
REMOVED = "-"  # blank and duplicate rows
SYMBOLS = KEPT + TRUNCATED + REMOVED
SPACES = " \t\n\x0b\x0c\r"

# What has been written so far: nothing, a system turn, a user turn last, an assistant turn last. A repaired
# conversation ends with nothing or an assistant turn.
STATES, FINAL = range(4), (0, 3)
BY_TURN = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}  # by a turn of the role that is due
DUE = {0: "user", 1: "user", 2: "assistant", 3: "user"}

Matrix = list[list[tuple | None]]  # [from][to]: cost and audit rope of the cheapest way, or None


def _letters(rope) -> Iterator[str]:
    """The strings of a rope, a string or a pair of ropes, from left to right."""
    waiting = [rope]
    while waiting:
        now = waiting.pop()
        if isinstance(now, str):
            yield from now
        else:
            waiting += (now[1], now[0])


def _less(one, other) -> bool:
    """Whether one rope's string comes first; looks no further than the first difference.

    Ways of equal cost between the same states are never prefixes of each other, as edits determine
    states and the rest would be insertions, which cost. So the smaller string stays smaller whatever follows.
    """
    for a, b in zip(_letters(one), _letters(other)):
        if a != b:
            return a < b
    return False


def _better(way, than) -> bool:
    return than is None or way[0] < than[0] or (way[0] == than[0] and _less(way[1], than[1]))


def times(left: Matrix, right: Matrix) -> Matrix:
    """The cheapest ways through both, with the least audit among equals."""
    out: Matrix = [[None] * 4 for _ in STATES]
    for row, made in zip(left, out):
        for first, line in zip(row, right):
            if first is None:
                continue
            for to, second in enumerate(line):
                if second is not None:
                    way = (first[0] + second[0], (first[1], second[1]))
                    if _better(way, made[to]):
                        made[to] = way
    return out


def insertions() -> Matrix:
    """Empty turns between two rows: a third one would only come back to a state seen before."""
    out: Matrix = [[None] * 4 for _ in STATES]
    for state in STATES:
        at = state
        for n in range(3):
            if _better(way := (n * INSERT, "I" * n), out[state][at]):
                out[state][at] = way
            at = NEXT[at]
    return out


def row_matrix(symbol: str) -> Matrix:
    """One row, after any insertions before it."""
    out: Matrix = [[None] * 4 for _ in STATES]
    extra = CUT_OFF if symbol in TRUNCATED else 0
    for state in STATES:
        ways = [(state, DELETE, "D")]
        if symbol != REMOVED:
            ways.append((NEXT[state], RETELL + extra, "R"))
            kept = BY_TURN.get(symbol.lower(), {}).get(state)
            if kept is not None:
                ways.append((kept, extra, "K"))
        for to, cost, letter in ways:
            if _better((cost, letter), out[state][to]):
                out[state][to] = (cost, letter)
    return times(insertions(), out)


Rounds = list[list[tuple[int, int]]]


class Grammar:
    """Pairs of symbols that became symbols, round by round, and one matrix per symbol.

    Within a round no symbol is the first of one pair and the second of another, so replacements never
    compete, but for runs of one symbol, which are paired from the left.
    """

    def __init__(self, rounds: Rounds):
        self.rounds = rounds
        self.matrices = [row_matrix(s) for s in SYMBOLS]
        for pairs in rounds:
            self.matrices += [times(self.matrices[a], self.matrices[b]) for a, b in pairs]
        self.last = insertions()
        self.known: dict[str, tuple[int, str]] = {}

    def compressed(self, ids: np.ndarray) -> np.ndarray:
        """Any number of sequences of symbol numbers, each followed by -1, with all pairs replaced."""
        fresh = len(SYMBOLS)
        for pairs in self.rounds:
            top = fresh + len(pairs)
            code = np.array([a * top + b for a, b in pairs])
            by_code = np.argsort(code)
            here = np.where((ids[:-1] >= 0) & (ids[1:] >= 0), ids[:-1] * top + ids[1:], -1)
            at = np.minimum(np.searchsorted(code[by_code], here), len(code) - 1)
            hit = code[by_code][at] == here
            place = np.arange(len(hit))
            begins = np.maximum.accumulate(np.where(hit & ~np.concatenate([[False], hit[:-1]]), place, -1))
            hit &= (place - begins) % 2 == 0
            ids = ids.copy()
            ids[:-1][hit] = fresh + by_code[at[hit]]
            ids = np.delete(ids, np.flatnonzero(hit) + 1)
            fresh = top
        return ids

    def edits(self, symbols: str) -> tuple[int, str]:
        """Cost and audit of the cheapest repair of one conversation; equal sequences are solved once."""
        found = self.known.get(symbols)
        if found is None:
            factors = [self.matrices[s] for s in self.compressed(numbers([symbols]))[:-1]] + [self.last]
            while len(factors) > 1:  # balanced, so ropes stay shallow
                pairs = [times(a, b) for a, b in zip(factors[::2], factors[1::2])]
                factors = pairs + factors[2 * len(pairs) :]
            best = None
            for state in FINAL:
                way = factors[0][0][state]
                if way is not None and _better(way, best):
                    best = way
            found = best[0], "".join(_letters(best[1]))
            if len(self.known) < 100_000 and len(symbols) <= 64:
                self.known[symbols] = found
        return found


def numbers(sequences: list[str]) -> np.ndarray:
    """The symbols of some sequences as numbers, with -1 after each."""
    table = np.full(256, -1, dtype=np.int64)
    table[list(SYMBOLS.encode())] = np.arange(len(SYMBOLS))
    return table[np.frombuffer("".join(s + "\n" for s in sequences).encode(), dtype=np.uint8)]


def learn(sequences: DataFrame) -> Grammar:
    """The grammar of ``sequences (symbols)``: each round counts pairs of neighbours over all distinct sequences.

    The most frequent pairs, ``RULES_A_ROUND`` of each round's at most, become rules. The rules speed the repair up and share
    its work; its result is the same with any of them.
    """
    rounds: Rounds = []
    for _ in range(ROUNDS):
        grammar = Grammar(rounds)

        def run(batches: Iterator[pa.RecordBatch], grammar=grammar) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = grammar.compressed(numbers(batch["symbols"].to_pylist()))
                pairs = ids[:-1] << 32 | ids[1:]
                found, n = np.unique(pairs[(ids[:-1] >= 0) & (ids[1:] >= 0)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["pair", "n"])

        counted = sequences.mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
        most = counted.where("n > 1").orderBy(F.desc("n"), "pair").limit(RULES_A_ROUND).collect()
        chosen: list[tuple[int, int]] = []
        for a, b in ((r["pair"] >> 32, r["pair"] & 0xFFFFFFFF) for r in most):
            competes = (a == d or b == c or (c == d and c in (a, b)) or (a == b and a in (c, d)) for c, d in chosen)
            if not any(competes):
                chosen.append((a, b))
        if not chosen:
            break
        rounds.append(chosen)
    return Grammar(rounds)


def marked(rows: DataFrame) -> DataFrame:
    """Distinct rows with their number ``n``, their symbol and their counts of faults.

    The first row of a role and text in its conversation may stay, all others are duplicates. Firsts are found
    by an aggregate and come back as rows of their own, so no window holds a conversation.
    """
    said = rows.select(
        "conv_id",
        "turn",
        F.coalesce(F.col("role"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text"), F.lit(" ")).alias("text"),
    ).select("*", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text", F.length("text")).alias("k2"))
    key = ["conv_id", "turn", "role", "k1", "k2"]
    early = F.struct(F.col("turn").isNotNull().alias("given"), "turn")
    firsts = said.groupBy("conv_id", "role", "k1", "k2").agg(F.min(early).alias("at"))
    firsts = firsts.select("conv_id", F.col("at.turn").alias("turn"), "role", "k1", "k2")
    both = said.select(*key, "text", F.lit(1).alias("n"), F.lit(0).alias("first")).unionByName(
        firsts.select(*key, F.lit(None).cast("string").alias("text"), F.lit(0).alias("n"), F.lit(1).alias("first"))
    )
    merged = both.groupBy(*key).agg(
        F.sum("n").alias("n"), F.max("first").alias("first"), F.first("text", ignorenulls=True).alias("text")
    )
    trimmed = F.rtrim("text", F.lit(SPACES))
    whole = merged.select(
        "conv_id", "turn", "role", "text", "n", (F.col("first") == 1).alias("first"),
        F.substring("role", 1, 1).alias("initial"), (trimmed == "").alias("is_blank"),
        (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("is_cut"),
    )
    place = F.when(F.col("initial").isin("s", "u", "a"), F.instr(F.lit(KEPT), F.col("initial"))).otherwise(4)
    symbol = F.when(F.col("is_blank") | ~F.col("first"), REMOVED).when(
        F.col("is_cut"), F.substring(F.lit(TRUNCATED), place, F.lit(1))
    )
    one = F.lit(1).cast("long")
    fresh = F.when(F.col("first"), one).otherwise(F.lit(0).cast("long"))
    return whole.select(
        "conv_id", "turn", "role", "text", "n", "initial",
        symbol.otherwise(F.substring(F.lit(KEPT), place, F.lit(1))).alias("symbol"),
        F.when(F.col("is_blank"), F.col("n")).otherwise(0).alias("blank"),
        F.when(F.col("is_blank"), 0).otherwise(F.col("n") - fresh).alias("duplicate"),
        F.when(F.col("is_blank") | ~F.col("is_cut"), 0).otherwise(fresh).alias("truncated"),
    )


ORDER = ["conv_id", "turn", "role", "text"]
COUNTS = ["blank", "duplicate", "truncated"]
BLOCK = (
    "conv_id bigint, part bigint, symbols string, head string, tail string, illegal bigint, turns bigint,"
    " low bigint, high bigint, blank bigint, duplicate bigint, truncated bigint"
)


def _legal(one: str, other: str) -> bool:
    return one + other in ("su", "ua", "au")


def blocks(rows: DataFrame) -> DataFrame:
    """Runs of neighbouring rows of one conversation: their symbols, initials at both ends, and counts.

    Marked rows are dealt by ranges of their order, so a conversation of any length is read by several tasks.
    """
    names = [c.strip().split(" ")[0] for c in BLOCK.split(",")]
    types = [pa.string() if n in ("symbols", "head", "tail") else pa.int64() for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, now, done, said = TaskContext.get().partitionId() << 32, None, [], 0

        def close() -> None:
            nonlocal part
            if now is not None:
                done.append([now["conv_id"], part, "".join(now["symbols"]), *(now[n] for n in names[3:])])
                part += 1

        def taken() -> pa.RecordBatch:
            columns = list(zip(*done)) or [()] * len(names)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        for batch in batches:
            for row in batch.to_pylist():
                again = row["n"] - 1
                if now is None or row["conv_id"] != now["conv_id"] or now["size"] >= BLOCK_ROWS:
                    close()
                    now = {"conv_id": row["conv_id"], "symbols": [], "head": row["initial"], "tail": None, "size": 0,
                           "illegal": 0, "turns": 0, "low": None, "high": None, **dict.fromkeys(COUNTS, 0)}
                elif not _legal(now["tail"], row["initial"]):
                    now["illegal"] += 1
                if again and not _legal(row["initial"], row["initial"]):
                    now["illegal"] += again
                now["symbols"].append(row["symbol"] + REMOVED * again)
                now["size"] += 1
                now["tail"] = row["initial"]
                if row["turn"] is not None and row["turn"] != now["high"]:
                    now["turns"] += 1
                    now["low"] = row["turn"] if now["low"] is None else now["low"]
                    now["high"] = row["turn"]
                for c in COUNTS:
                    now[c] += row[c]
                said += 1
                if said % BLOCK_ROWS == 0:
                    yield taken()
        close()
        yield taken()

    ranged = rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    return ranged.select("conv_id", "turn", "n", "initial", "symbol", *COUNTS).mapInArrow(run, BLOCK)


SUMMARY = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def summaries(read: DataFrame, grammar: Grammar) -> DataFrame:
    """One row per conversation from its blocks in order: faults, cost and audit.

    Blocks without symbols stand for conversations without rows.
    """
    names = [c.strip().split(" ")[0] for c in SUMMARY.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, whole in zip(batch["conv_id"].to_pylist(), batch["whole"].to_pylist()):
                whole = [b for b in whole if b["symbols"]]
                dated = [b for b in whole if b["turns"]]
                turns = sum(b["turns"] for b in dated) - sum(a["high"] == b["low"] for a, b in zip(dated, dated[1:]))
                gaps = dated[-1]["high"] - dated[0]["low"] + 1 - turns if dated else 0
                illegal = sum(b["illegal"] for b in whole)
                illegal += sum(not _legal(a["tail"], b["head"]) for a, b in zip(whole, whole[1:]))
                cost, audit = grammar.edits("".join(b["symbols"] for b in whole))
                out.append((conv, gaps, *(sum(b[c] for b in whole) for c in COUNTS), illegal, cost, audit))
            columns = list(zip(*out)) or [()] * len(names)
            kinds = [pa.string() if n == "audit" else pa.int64() for n in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    parts = F.struct("part", "symbols", "head", "tail", "illegal", "turns", "low", "high", *COUNTS)
    grouped = read.groupBy("conv_id").agg(F.array_sort(F.collect_list(parts)).alias("whole"))
    return grouped.mapInArrow(run, SUMMARY)


class _Applied:
    """An audit, followed row by row."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield "I", DUE[self.state], ""
            self.state = NEXT[self.state]

    def turns(self, role: str, text: str, n: int) -> Iterator[tuple[str, str, str]]:
        """What becomes of ``n`` equal rows, deletions left out."""
        for _ in range(n):
            yield from self.inserted()
            letter = self.audit[self.at]
            self.at += 1
            if letter == "K":
                self.state = BY_TURN[role[0]][self.state]
                yield letter, role, text
            elif letter == "R":
                yield letter, DUE[self.state], text
                self.state = NEXT[self.state]


def repair(rows: DataFrame, conversations: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Faults, cheapest edits and what is needed to apply them.

    ``rows`` has ``conv_id, turn, role, text``; turns stand in the order of ``turn`` (nulls first), then role and
    text. Null roles and texts are one space. Each row's first fault counts: blank, duplicate (role and
    text seen before in the conversation), truncated (last character that is no space not one of ``.!?``).
    Edits make the roles ``(s?(ua)+)?`` by their initials; of cheapest ones the least audit in ASCII is taken, over K(eep),
    R(erole), D(elete), I(nsert). A null conv_id is a conversation of its own; repeated rows are
    duplicates. ``conversations (conv_id)`` names further ones that are to be reported even without rows.

    Returns ``SUMMARY`` per conversation and the marked rows that ``repaired_turns`` and ``digests`` read. A
    conversation's symbols, a byte a row, and its audit are one value each.
    """
    given = settle(marked(rows), "marked")
    read = settle(blocks(given), "blocks")
    grammar = learn(read.select("symbols").distinct())
    if conversations is not None:
        none = conversations.select("conv_id").distinct()
        read = read.unionByName(none.select("conv_id", F.lit("").alias("symbols")), allowMissingColumns=True)
    return settle(summaries(read, grammar), "summaries"), given


def _followed(summary: DataFrame, given: DataFrame) -> DataFrame:
    """Each conversation's summary and then its rows in order, in one task; nothing of it is collected there."""
    facts = summary.select("conv_id", F.lit(0).alias("kind"), F.struct(*summary.columns[1:]).alias("facts"))
    turns = given.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", "n")
    both = facts.unionByName(turns, allowMissingColumns=True).repartition("conv_id")
    return both.sortWithinPartitions("conv_id", "kind", "turn", "role", "text")


def repaired_turns(summary: DataFrame, given: DataFrame) -> DataFrame:
    """The repaired conversations: ``conv_id, position, edit, role, text``, without deleted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "position", "edit", "role", "text"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        now, conv, position = None, None, 0
        for batch in batches:
            out = []

            def write(turns) -> None:
                nonlocal position
                for turn in turns:
                    out.append((conv, position, *turn))
                    position += 1

            for row in batch.to_pylist():
                if row["kind"] == 0:
                    if now is not None:
                        write(now.inserted())
                    now, conv, position = _Applied(row["facts"]["audit"]), row["conv_id"], 0
                else:
                    write(now.turns(row["role"], row["text"], row["n"]))
            columns = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
        if now is not None:
            last = [(conv, position + k, *turn) for k, turn in enumerate(now.inserted())]
            columns = list(zip(*last)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return _followed(summary, given).mapInArrow(
        run, "conv_id bigint, position bigint, edit string, role string, text string"
    )


def digests(summary: DataFrame, given: DataFrame) -> DataFrame:
    """``SUMMARY`` and ``repaired_sha256`` of the repaired ``role:text``, joined by line feeds, made turn by turn."""
    names = [c.strip().split(" ")[0] for c in SUMMARY.split(",")] + ["repaired_sha256"]
    types = [pa.string() if n in ("audit", "repaired_sha256") else pa.int64() for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, said, digest, facts = None, False, None, None

        def write(turns) -> None:
            nonlocal said
            for _, role, text in turns:
                digest.update(("\n" * said + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                said = True

        def closed() -> tuple:
            write(now.inserted())
            return (*facts, digest.hexdigest())

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    if now is not None:
                        out.append(closed())
                    facts = (row["conv_id"], *(row["facts"][n] for n in names[1:-1]))
                    now, said, digest = _Applied(row["facts"]["audit"]), False, hashlib.sha256()
                else:
                    write(now.turns(row["role"], row["text"], row["n"]))
            columns = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(closed(), types)], names)

    return _followed(summary, given).mapInArrow(run, f"{SUMMARY}, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """Faults by ``crc32(conv_id:turn) % 20``: 0 drops a row, 1 empties its text, 2 takes ``.!?`` out, 3 repeats it, 4 makes it the user's.

    Nulls are one space, but in ``conv_id`` and ``turn`` themselves.
    """
    space = F.lit(" ")
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
    fault = (F.crc32(name) % 20).alias("_fault")
    text, role = F.coalesce("text", space).alias("text"), F.coalesce("role", space).alias("role")
    hurt = rows.select("conv_id", "turn", role, text, fault).where("_fault != 0")
    text = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.regexp_replace("text", "[.!?]", ""))
    role = F.when(F.col("_fault") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("_fault") == 3, 2).otherwise(1)))
    hurt = hurt.select("conv_id", "turn", role.alias("role"), text.otherwise(F.col("text")).alias("text"), copies)
    return hurt.select("conv_id", "turn", "role", "text")
