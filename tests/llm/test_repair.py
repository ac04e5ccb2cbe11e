"""Operator 11: the agenda against all derivations, windows, and the query against plain Python."""

import hashlib
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from tessella.llm import conversation_repair as cr
from tessella.llm import repair_agenda as ra

SEEN = re.compile(r"[^\x20\x09-\x0D]")


def every_derivation(rows):
    """(cost, audit, repaired rows) of the best edit sequence, by trying all: at most one insertion before each row and two at the end."""
    faults, seen = [], set()
    for role, text in rows:
        last = SEEN.findall(text)
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else None if last[-1] in ".!?" else "truncated")
        seen.add((role, text))
    best = None
    choices = ["D" if f in ("blank", "duplicate") else "KDUA" for f in faults]
    gaps = itertools.product(["", "U", "A", "UA", "AU"], repeat=len(rows) + 1)
    gaps = [g for g in gaps if sum(map(len, g)) <= 2]
    for edits in itertools.product(*choices):
        for gap in gaps:
            cost, audit, kept = 0, "", []
            for i in range(len(rows) + 1):
                for g in gap[i]:
                    cost, audit = cost + 5, audit + "I"
                    kept.append(({"U": "user", "A": "assistant"}[g], ""))
                if i < len(rows):
                    e, (role, text) = edits[i], rows[i]
                    if e == "D":
                        cost, audit = cost + 2, audit + "D"
                        continue
                    cost += (e != "K") + 5 * (faults[i] == "truncated")
                    audit += "K" if e == "K" else "R"
                    kept.append((role if e == "K" else {"U": "user", "A": "assistant"}[e], text))
            if re.fullmatch(r"(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in kept)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, kept)
    return best, faults


def digest(rows):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in rows).encode()).hexdigest()


def chat(rng, n):
    texts = ["Yes.", "No!", "cut", "", " \t", "Why?", "ü.", "x\n. "]
    return [(rng.choice(["user", "assistant", "system", "user", "assistant", "", "tool", "s"]), rng.choice(texts)) for _ in range(n)]


def test_agenda_against_all_derivations():
    rng = random.Random(3)
    for k in range(250):
        rows = chat(rng, k % 5)
        best, _ = every_derivation(rows)
        c = ra.Conversation()
        seen = set()
        for i, (role, text) in enumerate(rows):
            c.add(i, role, text, (role, text) in seen)
            seen.add((role, text))
        *_, cost, audit, sha = c.result()
        assert (cost, audit, sha) == (*best[:2], digest(best[2])), rows


def whole(rows, window):
    c = ra.Conversation()
    ra.WINDOW, kept = window, ra.WINDOW
    try:
        seen = set()
        for i, (role, text) in enumerate(rows):
            c.add(i, role, text, (role, text) in seen)
            seen.add((role, text))
        return c.result()
    finally:
        ra.WINDOW = kept


def test_windows_change_nothing():
    rng = random.Random(4)
    for k in range(150):
        rows = [(r, t + str(i) + "." if t else t) for i, (r, t) in enumerate(chat(rng, 5 + k % 40))]
        if k % 3 == 0:
            rows = [("user", f"{i}.") for i in range(31)]  # ties between early and late edits
        assert whole(rows, 1) == whole(rows, 3) == whole(rows, 7) == whole(rows, 10_000)


def plain(rows):
    """The contract in plain Python, on (conv_id, turn, role, text)."""
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        mine = out.setdefault(conv, [])
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            mine += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    found = {}
    for conv, mine in out.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        best, faults = every_derivation([r[1:] for r in mine])
        turns = {r[0] for r in mine} - {None}
        initials = [r[1][:1] for r in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        found[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, best[0], best[1], digest(best[2]))
    return found


def odd_chats():
    rng = random.Random(8)
    rows = [(c, t, *r) for c in range(60) for t, r in enumerate(chat(rng, rng.randint(1, 4)))]
    rows += [(None, 1, "user", "Hi."), (None, None, "assistant", "Ho."), (70, None, None, None), (70, None, "user", "A."), (71, 5, "user", None), (72, 9, "user", "B."), (72, 2, "assistant", "C.")]
    return rows + [(73, 1, "user", "Same.")] * 2 + [(74, 1, "user", "Same."), (74, 7, "user", "Same.")]


def test_query_against_plain_python(spark):
    rows = odd_chats()
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({"copies": F.lit(7), "late": F.lit(True), "h1": F.lit("x")})
    got = {r.conv_id: tuple(r)[1:] for r in cr.repair(cr.damaged(df.repartition(3)), "copies").collect()}
    assert got == plain(rows)
    assert {"D", "K", "R"} <= set("".join(r[6] for r in got.values()))


def test_repaired_rows_have_the_digest(spark):
    rows = odd_chats()
    df = cr.damaged(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    kept = {}
    for r in sorted(cr.repaired_rows(df, "copies").collect(), key=lambda r: (str(r.conv_id), r.place)):
        kept.setdefault(r.conv_id, []).append((r.role, r.text))
    for r in cr.repair(df, "copies").collect():
        assert digest(kept.get(r.conv_id, [])) == r.repaired_sha256
        assert re.fullmatch(r"(s?(ua)+)?", "".join(role[:1] for role, _ in kept.get(r.conv_id, [])))


def test_long_and_empty_conversations(spark):
    n = 3_000
    rows = [(1, i, ("user", "assistant")[i % 2], f"Turn {i}.") for i in range(n)] + [(2, i, "user", "ok") for i in range(n)] + [(3, 0, "user", "x" * 3_000_000 + "."), (3, 1, "assistant", "!")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    df = df.withColumn("copies", F.lit("clash"))
    got = {r.conv_id: r for r in cr.repair(df).collect()}
    assert (got[1].cost, got[1].audit) == (0, "K" * n) and got[1].repaired_sha256 == digest([r[2:] for r in rows[:n]])
    assert (got[2].duplicate, got[2].cost, got[2].audit) == (n - 1, 2 * n, "D" * n)
    assert got[3].audit == "KK" and got[3].gaps == 0
    assert cr.repair(df.limit(0)).count() == 0 and cr.repaired_rows(df.limit(0)).count() == 0
