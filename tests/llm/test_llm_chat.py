"""Chat formatting round trips; conversation repair against every edit sequence and against a plain search."""

import collections
import hashlib
import itertools
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row

from spendscope.llm import chat_format, chat_repair, queries

SCHEMA = "conv_id long, turn long, role string, text string"
HARD = "<|im_start|> <\\|im_end|> <\\\\| <| <|im_sep|> < | \\| 🙂 é"
ROWS = [
    (1, 0, "system", "Be brief."), (1, 1, "user", "Hello?"), (1, 2, "assistant", HARD), (1, 2, "assistant", HARD),
    (2, None, "user", "late or early."), (2, 5, None, "no role."), (2, 5, "tool", None), (2, 9, "assistant", ""),
    (None, 0, "user", "nobody's"), (None, None, None, None), (3, 1, "assistant", "Yes. \n\t"), (3, 2, "user<|im_sep|>\n", "x" * 200_000 + "."),
    (4, -3, "", " \x0b "), (5, 1, "user", "a."), (5, 1, "user", "A."), (5, 1, "user", "a."), (5, 4, "user", "a."), (6, 2, "useless", "ok!"),
]


def conversations(spark, rows=ROWS):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return frame.selectExpr("*", "1 as part", "2 as n", "'x' as symbol", "3 as piece", "4 as facts", "5 as kind")


def order(row):
    return (row[1] is not None, row[1] or 0, row[2] or "", row[3] or "")


def by_conversation(rows):
    found = collections.defaultdict(list)
    for row in rows:
        found[row[0]].append(row)
    return {k: sorted(v, key=order) for k, v in found.items()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_formatted_texts_can_be_read_back(spark):
    found = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_chats(conversations(spark))).collect()}
    wanted = by_conversation(ROWS)
    assert set(found) == set(wanted)
    for conv, rows in wanted.items():
        r = found[conv]
        learned = "".join(row[3] or "" for row in rows if row[2] == "assistant")
        assert r["n_turns"] == len(rows)
        assert r["turns_sha256"] == sha("".join(f"{row[2] or ''}\n{row[3] or ''}\n" for row in rows))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learned), sha(learned))


def test_no_text_holds_a_control_string(spark):
    for r in chat_format.format_chats(conversations(spark)).where("conv_id = 1").collect():
        assert len(re.findall(r"<\|", r["formatted"])) == 3 * r["n_turns"]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="<|\\a ", max_size=12))
def test_escapes_come_back(text):
    hidden = re.sub(r"<(\\*)\|", r"<\1\\|", text)
    assert "<|" not in hidden and chat_format.unescaped(hidden) == text


@pytest.fixture
def many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_a_long_conversation_goes_on_in_further_parts(spark, many_tasks):
    rows = [(7, k, "assistant" if k % 2 else "user", f"turn {k} " + "y" * 50) for k in range(500)]
    whole = chat_format.format_chats(conversations(spark, rows).repartition(8)).collect()
    assert len({r["part"] for r in whole}) == len(whole) > 1
    back = chat_format.read_back(chat_format.format_chats(conversations(spark, rows))).collect()
    assert [r["turns_sha256"] for r in back] == [sha("".join(f"{r[2]}\n{r[3]}\n" for r in rows))]


def test_typed_parts(spark):
    part = Row("kind", "text", "uri", "width", "height", "seconds", "pages")
    parts = [
        part("text", "see <|image|> ", None, None, None, None, None), part("image", None, "s3://a", 57, 28, None, None),
        part(None, "and", None, None, None, None, None), part("audio", None, "s3://b", None, None, 1.5, None),
        part("document", None, "s3://c", None, None, None, 2), part("video", None, "s3://d", None, None, None, None),
        part("image", None, None, None, 5, None, None), None,
    ]
    rows = spark.createDataFrame(
        [(1, 0, "user", "unused", parts), (1, 1, "assistant", "plain text", None), (1, 2, "user", None, [])],
        f"{SCHEMA}, parts array<{chat_format.PART}>",
    )
    (r,) = chat_format.format_chats(rows).collect()
    text = r["formatted"]
    assert text == (
        "<|im_start|>assistant<|im_sep|>plain text<|im_end|>\n" if r["n_turns"] == 1 else
        "<|im_start|>user<|im_sep|>see <\\|image|> <|image|>and<|audio|><|document|><|file|><|image|><|im_end|>\n"
        "<|im_start|>assistant<|im_sep|>plain text<|im_end|>\n<|im_start|>user<|im_sep|><|im_end|>\n"
    )
    assert [(a["kind"], a["uri"], a["tokens"]) for a in r["attachments"]] == [
        ("image", "s3://a", 3), ("audio", "s3://b", 38), ("document", "s3://c", 3000), ("file", "s3://d", 0), ("image", None, 256),
    ]
    assert all(text[a["at"] :].startswith(f"<|{a['kind']}|>") for a in r["attachments"])
    assert [text[s["start"] : s["end"]] for s in r["loss"]] == ["plain text"]
    assert r["n_tokens"] == 2 + 1 + 3 + 38 + 3000 + 256 + 2


def legal(initials):
    return re.fullmatch("(s?(ua)+)?", initials) is not None


def every_repair(symbols):
    """The cheapest audit by trying them all."""
    best = None
    for letters in itertools.product("DKR", repeat=len(symbols)):
        for extra in itertools.product(("", "I", "II"), repeat=len(symbols) + 1):
            audit = "".join(e + x for e, x in zip(extra, letters)) + extra[-1]
            cost, written, at, ok = 0, "", 0, True
            for x in audit:
                due = "a" if written.endswith("u") else "u"
                if x == "I":
                    cost, written = cost + 3, written + due
                    continue
                s, at = symbols[at], at + 1
                if x == "D":
                    cost += 4
                    continue
                ok = ok and s != "-"
                cost += 3 * s.isupper() + 3 * (x == "R")
                written += due if x == "R" else s.lower()
            if ok and legal(written):
                best = min(best or (cost, audit), (cost, audit))
    return best


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="suaxSUAX-", max_size=4), st.booleans())
def test_cheapest_and_least_audit(symbols, ruled):
    number = chat_repair.SYMBOLS.index
    rounds = [[(number("u"), number("a")), (number("-"), number("-"))], [(9, 9), (number("s"), number("u"))], [(11, 11)]]
    assert chat_repair.Grammar(rounds if ruled else []).edits(symbols) == every_repair(symbols)


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="ua-s", max_size=60))
def test_rules_change_nothing(symbols):
    number = chat_repair.SYMBOLS.index
    rounds = [[(number("u"), number("a")), (number("-"), number("-"))], [(9, 9), (10, 9)], [(11, 11)], [(13, 13)]]
    assert chat_repair.Grammar(rounds).edits(symbols) == chat_repair.Grammar([]).edits(symbols)


def plain_repair(rows):
    """Faults and repair of one conversation by a search over states from the end, then the least letters from the start."""
    symbols, counts, seen = [], collections.Counter(), set()
    for _, _, role, text in rows:
        last = text.strip(" \t\n\x0b\x0c\r")
        if not last:
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        else:
            fault = "" if last[-1] in ".!?" else "truncated"
        seen.add((role, text))
        counts[fault] += 1
        symbols.append((role[:1], fault))
    steps = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    due = {"": "u", "s": "u", "u": "a", "a": "u"}
    costs = [None] * (len(rows) + 1)

    def options(k, state):
        yield "I", 3, k, due[state], ("user" if due[state] == "u" else "assistant", "")
        if k < len(rows):
            initial, fault = symbols[k]
            yield "D", 4, k + 1, state, None
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                yield "R", 3 + more, k + 1, due[state], ("user" if due[state] == "u" else "assistant", rows[k][3])
                if (state, initial) in steps:
                    yield "K", more, k + 1, initial, rows[k][2:]

    for k in range(len(rows), -1, -1):
        now = {s: (0 if k == len(rows) and s in ("", "a") else 10**9) for s in ("", "s", "u", "a")}
        costs[k] = now
        for _ in range(4):
            for s in now:
                now[s] = min([now[s], *(c + costs[at][to] for _, c, at, to, _ in options(k, s))])
    k, state, audit, written = 0, "", "", []
    while not (k == len(rows) and costs[k][state] == 0):
        for letter, cost, at, to, turn in sorted(options(k, state), key=lambda o: o[0]):
            if cost + costs[at][to] == costs[k][state]:
                audit += letter
                written += [turn] if turn else []
                k, state = at, to
                break
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, costs[0][""], audit,
            sha("\n".join(f"{r}:{t}" for r, t in written)))


def plainly_damaged(rows):
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = (" " if v is None else v for v in (role, text))
        fault = zlib.crc32(name.encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        yield from [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)


def check(found, rows):
    wanted = by_conversation(plainly_damaged(rows))
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    assert sorted(map(str, (r["conv_id"] for r in found))) == sorted(map(str, {r[0] for r in rows}))
    for r in found:
        assert tuple(r[n] for n in names) == plain_repair(wanted.get(r["conv_id"], [])), r["conv_id"]


def test_repair_of_the_table(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(queries.op13_chat_repair(spark, folder).collect(), rows)


def test_repair_of_odd_rows(spark):
    given = conversations(spark)
    check(chat_repair.digests(*chat_repair.repair(chat_repair.damaged(given), given)).collect(), ROWS)


def test_repair_of_a_conversation_of_many_blocks(spark, many_tasks):
    rows = [(1, k // 2, ("user", "assistant", "system", "tool")[k * k % 7 % 4], f"{k % 300}." if k % 5 else "cut") for k in range(9000)]
    rows += [(k, t, r, f"{k}.") for k in range(2, 40) for t, r in enumerate(("user", "assistant"))]
    given = conversations(spark, rows).repartition(5)
    check(chat_repair.digests(*chat_repair.repair(chat_repair.damaged(given), given)).collect(), rows)


def test_repaired_turns(spark):
    given = conversations(spark)
    turns = chat_repair.repaired_turns(*chat_repair.repair(given))
    found = {c: [(r["edit"], r["role"], r["text"]) for r in sorted(v, key=lambda r: r["position"])]
             for c, v in itertools.groupby(sorted(turns.collect(), key=lambda r: r["conv_id"] or 0), key=lambda r: r["conv_id"])}
    assert found[1] == [("K", "system", "Be brief."), ("K", "user", "Hello?"), ("K", "assistant", HARD)]
    assert found[6] == [("K", "useless", "ok!"), ("I", "assistant", "")]
    assert 4 not in found


@pytest.mark.parametrize("form", [
    lambda d: chat_format.format_chats(d), lambda d: chat_format.read_back(chat_format.format_chats(d)),
    lambda d: chat_repair.digests(*chat_repair.repair(d, d)), lambda d: chat_repair.repaired_turns(*chat_repair.repair(d)),
])
def test_no_rows(spark, form):
    assert form(conversations(spark, [])).count() == 0
