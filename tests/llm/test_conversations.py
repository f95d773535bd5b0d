import hashlib
import itertools
import random
import re
import zlib

import pytest

from loomtext.llm import conversations as C
from tests.compare import duck_rows, spark_rows

WORD = re.compile(r"[^\x20\x09-\x0D]")


def damage(rows):
    """Damaged rows by conversation, every id kept."""
    out = {}
    for key, turn, role, text in rows:
        own = out.setdefault(key, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if key is None else key}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for own in out.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        found = WORD.findall(text)
        out.append("blank" if not found else "duplicate" if (role, text) in seen else "truncated" if found[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, bad):
    """The least (cost, audit) with its turns, by a search over whole sequences of
    edits, cheapest and ASCII-least first; nothing is shared with the operator."""
    best = None
    inserts = [list(c) for n in range(3) for c in itertools.product(("user", "assistant"), repeat=n)]
    choices = [[("D",)] if b in ("blank", "duplicate") else [("D",), ("K", r[1]), ("R", "user"), ("R", "assistant")] for r, b in zip(rows, bad)]
    for own in itertools.product(*choices):
        base = sum({"D": 3, "K": 0, "R": 2}[e[0]] + (b == "truncated" and e[0] != "D") for e, b in zip(own, bad))
        for more in itertools.product(inserts, repeat=len(rows) + 1):
            cost = base + 2 * sum(map(len, more))
            if best and cost > best[0]:
                continue
            audit, turns = "", []
            for i in range(len(rows) + 1):
                audit += "I" * len(more[i])
                turns += [(r, "") for r in more[i]]
                if i < len(rows):
                    audit += own[i][0]
                    turns += [(own[i][1], rows[i][2])] if own[i][0] != "D" else []
            if all(r for r, _ in turns) and re.fullmatch(r"(s?(ua)+)?", "".join(r[0] for r, _ in turns)) and (not best or (cost, audit) < best[:2]):
                best = cost, audit, turns
    return best


def report(rows, solve):
    bad = faults(rows)
    cost, audit, turns = solve(rows, bad)
    known = sorted({t for t, _, _ in rows if t is not None})
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    said = "\n".join(f"{r}:{t}" for r, t in turns)
    return (known[-1] - known[0] + 1 - len(known) if known else 0, bad.count("blank"), bad.count("duplicate"), bad.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(said.encode()).hexdigest())


def quadratic(rows, bad):
    """The same least by a table over (row, state) of whole (cost, audit, turns) values."""
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    roles = {"u": "user", "a": "assistant"}
    best = {q: min(options) for q, options in {"": [(0, "", ())], "a": [(0, "", ())], "u": [(2, "I", (("assistant", ""),))], "s": [(4, "II", (("user", ""), ("assistant", "")))]}.items()}
    for row, b in zip(reversed(rows), reversed(bad)):
        new = {}
        for q in after:
            options = [(3 + best[q][0], "D" + best[q][1], best[q][2])]
            if b not in ("blank", "duplicate"):
                more = b == "truncated"
                for to in after[q].values():
                    c, a, t = best[to]
                    if row[1][:1] == to:
                        options.append((c + more, "K" + a, ((row[1], row[2]), *t)))
                    if to in roles:
                        options.append((c + more + 2, "R" + a, ((roles[to], row[2]), *t)))
            new[q] = min(options, key=lambda o: o[:2])
        for _ in range(3):
            for q in after:
                to = "u" if q != "u" else "a"
                c, a, t = new[to]
                new[q] = min(new[q], (c + 2, "I" + a, ((roles[to], ""), *t)), key=lambda o: o[:2])
        best = new
    return best[""]


def got(df, **more):
    return {r[0]: tuple(r[1:]) for r in C.repair(df, **more).collect()}


SCHEMA = "conv_id long, turn long, role string, text string, digest string, audit int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def test_two_brute_forces_agree():
    rnd = random.Random(5)
    for _ in range(60):
        rows = [(i, rnd.choice(["user", "assistant", "system", "tool", " ", "admin"]), rnd.choice(["A.", "b", "", "c!"])) for i in range(rnd.randint(0, 3))]
        bad = faults(rows)
        assert cheapest(rows, bad)[:2] == quadratic(rows, bad)[:2]
        assert list(cheapest(rows, bad)[2]) == list(quadratic(rows, bad)[2])


def test_equals_brute_force(spark):
    rnd = random.Random(8)
    rows = []
    for key in [*range(600), None]:
        turns = [rnd.choice([None, *range(12)]) for _ in range(rnd.randint(1, 12))]
        rows += [(key, t, rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "admin"]), rnd.choice(["A.", "b", " ", None, "", "c!\n", "é?", "é? no", "x. y"])) for t in turns]
    rnd.shuffle(rows)
    own = got(frame(spark, rows))
    want = {k: report(r, quadratic) for k, r in damage(rows).items()}
    assert own == want


def test_turns_rebuild_the_digest(spark, sf):
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    want = {r.conv_id: r for r in C.repair(table).collect()}
    assert {k: report(r, quadratic) for k, r in damage([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]).items()} == {k: tuple(r[1:]) for k, r in want.items()}
    said = {}
    for r in sorted(C.repair(table, turns=True).collect(), key=lambda r: r.pos):
        said.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert all(hashlib.sha256("\n".join(said.get(k, [])).encode()).hexdigest() == r.repaired_sha256 for k, r in want.items())


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_blocks_of_a_long_conversation(monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    monkeypatch.setattr(C, "BLOCK_BYTES", 20 if block == 7 else 1 << 20)
    rnd = random.Random(block)
    for n in (0, 1, 6, 7, 8, 300):
        rows = [(i, rnd.choice(["user", "assistant", "system", "x"]), rnd.choice(["A.", "b", "", *map(str, range(99))])) for i in range(n)]
        bad = faults(rows)
        full = [[t, r, x, x, b == "blank", b == "duplicate", b == "truncated" or b == "", len(x)] for (t, r, x), b in zip(rows, bad)]
        for f, (_, _, x) in zip(full, rows):
            f[6] = not re.search(r"[.!?][\x20\x09-\x0D]*\Z", x)
        own = C.Conversation(1, lambda r: None)
        for r in reversed(full):
            own.add_symbol([*r[:3], None, *r[4:]])
        for r in full:
            own.add_row(r)
        assert tuple(own.report()[1:]) == report(rows, quadratic)


def test_nothing_left_long_texts_repeats_and_no_rows(spark):
    gone = next(i for i in range(10_000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Hi."), (10**12, None, None, None), (5, 0, "user", "x " * 500_000 + "."), *[(6, 3, "assistant", "Same.")] * 5]
    own = got(frame(spark, rows))
    assert own == {k: report(r, quadratic) for k, r in damage(rows).items()}
    assert own[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert C.repair(frame(spark, rows).limit(0)).count() == 0
    plain = got(frame(spark, [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, 1, "assistant", "Yes.")]), damage=False)
    assert plain[1][:7] == (0, 0, 1, 0, 1, 3, "KKD")


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_equals_sql(spark, folder):
    path = f"/root/testdata/{folder}"
    assert spark_rows(C.repair(spark.read.parquet(f"{path}/conversations.parquet"))) == duck_rows(C.oracle_sql(), path)
