"""Conversation repair against exhaustive search, and on nulls, ties, repeated rows and empty tables."""

import hashlib
import random
import re
import zlib

import pytest

from cloakwork.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, conv string, head int, extra string"
BLANK = " \t\n\r\x0b\x0c"


def cheapest(turns):
    """(cost, audit, repaired) by trying every edit of every turn, with inserted turns at every place, as far as deleting all isn't cheaper."""
    seen, options = set(), []
    for role, text in turns:
        core = text.strip(BLANK)
        faulty = not core or (role, text) in seen
        seen.add((role, text))
        late = 5 if core and core[-1] not in ".!?" else 0
        options.append([("D", 2, "", "")] + ([] if faulty else [("K", late, role[:1] or "?", f"{role}:{text}\n"), ("R", 1 + late, "u", f"user:{text}\n"), ("R", 1 + late, "a", f"assistant:{text}\n")]))
    best = (1 << 60, "", "")

    def go(i, cost, audit, roles, made):
        nonlocal best
        if cost > min(best[0], 2 * len(turns)):
            return
        if i == len(turns) and re.fullmatch("(s?(ua)+)?", roles):
            best = min(best, (cost, audit, made[:-1]))
        for role, name in (("u", "user"), ("a", "assistant")):
            go(i, cost + 5, audit + "I", roles + role, f"{made}{name}:\n")
        for edit, price, role, text in options[i] if i < len(turns) else []:
            go(i + 1, cost + price, audit + edit, roles + role, made + text)

    go(0, 0, "", "", "")
    return best


def damaged(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        one = lambda v: " " if v is None else v
        role, text, d = one(role), one(text), zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        if d == 1:
            text = ""
        if d == 2:
            text = re.sub("[.!?]", "", text)
        if d == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    return out


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = [r for r in damaged(rows) if r[0] == conv]
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest()))
        faults, seen = [], set()
        for _, _, role, text in mine:
            core = text.strip(BLANK)
            faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {r[1] for r in mine if r[1] is not None}
        cost, audit, text = cheapest([r[2:] for r in mine])
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def run(spark, tmp_path, rows):
    path = f"{tmp_path}/conversations.parquet"
    spark.createDataFrame([(*r, "c", 5, "x") for r in rows], SCHEMA).write.mode("overwrite").parquet(path)
    got = conversations.op13_conversation_repair(spark, str(tmp_path))
    assert [t for _, t in got.dtypes] == ["bigint"] * 7 + ["string"] * 2
    return got.collect()


def test_against_every_edit(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for conv in range(400):
        for turn in range(rng.randrange(1, 5)):
            rows.append((conv, turn + rng.randrange(2) * 3, rng.choice(["user", "assistant", "assistant", "system", "tool"]), rng.choice(["A b.", "C d!", "e f", "g", " \n", "A b. \t"])))
    rows += [(None, 1, "user", "Null conversation."), (None, None, None, None), (900, None, "user", "No turn."), (900, None, "assistant", "None."), (901, 3, "", "empty role."), (901, 4, "\U0001f600", "odd role."), (902, 1, "user", "Twice."), (902, 1, "user", "Twice.")]
    got = run(spark, tmp_path, rows)
    want = expected(rows)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r.conv_id], (r.conv_id, [x for x in damaged(rows) if x[0] == r.conv_id])


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, []) == []


@pytest.mark.parametrize("n", [20_000])
def test_long_conversation(spark, tmp_path, n):
    """One conversation that holds nearly all rows, and a very long text."""
    rows = [(1, i, ("user", "assistant")[i % 2], f"Turn {i}.") for i in range(n)] + [(2, 0, "user", "long " * 200_000 + "."), (2, 1, "assistant", "Yes.")]
    by = {r.conv_id: r for r in run(spark, tmp_path, rows)}
    kept = [x for x in damaged(rows) if x[0] == 1]
    assert len(by[1].audit.replace("I", "")) == len(kept)
    text, state, at = [], None, 0
    for _, _, role, words in kept:
        while by[1].audit[at] == "I":
            state = "assistant" if state == "user" else "user"
            text.append(f"{state}:")
            at += 1
        if by[1].audit[at] != "D":
            state = role if by[1].audit[at] == "K" else ("assistant" if state == "user" else "user")
            text.append(f"{state}:{words}")
        at += 1
    text += ["assistant:"] * (len(by[1].audit) - at)
    assert by[1].repaired_sha256 == hashlib.sha256("\n".join(text).encode()).hexdigest()
    assert by[1].cost == sum({"K": 0, "R": 1, "D": 2, "I": 5}[c] for c in by[1].audit) + 5 * sum(1 for c, x in zip(by[1].audit.replace("I", ""), kept) if c != "D" and x[3].strip()[-1:] not in ".!?")
