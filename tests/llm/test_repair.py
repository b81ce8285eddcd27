import hashlib
import random
import re
import zlib
from pathlib import Path

import pytest

from larder.llm import repair as rp

SF = "/root/testdata/sf0.001"


def cheapest(rows):
    """(cost, audit) by relaxing every edit until nothing changes; rows are (initial, must go, truncated)."""
    best = {(len(rows), s): (0, "") for s in "-a"}
    for k in range(len(rows), -1, -1):
        for _ in range(4):
            for state in "-sua":
                due = "a" if state == "u" else "u"
                found = [best[k, state]] if (k, state) in best else []

                def step(cost, letter, to, at):
                    if (at, to) in best:
                        found.append((cost + best[at, to][0], letter + best[at, to][1]))

                step(2, "I", due, k)
                if k < len(rows):
                    initial, gone, cut = rows[k]
                    step(3, "D", state, k + 1)
                    if not gone:
                        step(2 + cut, "R", due, k + 1)
                        if initial == due or (initial == "s" and state == "-"):
                            step(cut, "K", initial, k + 1)
                if found:
                    best[k, state] = min(found)
    return best[0, "-"]


def plain(rows):
    """Contract rows of (conv_id, turn, role, text), row by row."""
    out = []
    for conv in {r[0] for r in rows}:
        kept = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if case == 0:
                continue
            text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
            kept += [(turn, "user" if case == 4 else role, text)] * (2 if case == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults, symbols = set(), {"b": 0, "r": 0, "t": 0, "": 0}, []
        for _, role, text in kept:
            visible = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "b" if not visible else "r" if (role, text) in seen else "t" if visible[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            symbols.append((role[:1], fault in ("b", "r") and fault != "", fault == "t"))
        cost, audit = cheapest(symbols)
        lines, at, state = [], 0, "-"
        for letter in audit:
            due = "a" if state == "u" else "u"
            if letter == "I":
                lines.append({"u": "user:", "a": "assistant:"}[due])
            else:
                _, role, text = kept[at]
                at += 1
                if letter == "D":
                    continue
                due = role[0] if letter == "K" else due
                lines.append(f"{role if letter == 'K' else {'u': 'user', 'a': 'assistant'}[due]}:{text}")
            state = due
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:], strict=False))
        out.append((conv, gaps, faults["b"], faults["r"], faults["t"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def symbols(word):
    return [(c.lower(), c == "d", c.isupper()) for c in word]


def test_audits_are_the_cheapest_and_least():
    rng = random.Random(2)
    for _ in range(3000):
        word = "".join(rng.choice("suaxSUAXd") for _ in range(rng.randrange(12)))
        assert rp.repair(word) == cheapest(symbols(word)), word


def test_chunks(monkeypatch):
    monkeypatch.setattr(rp, "CHUNK", 3)
    rng = random.Random(3)
    for _ in range(600):
        word = "".join(rng.choice("sssuuuaaaxSUAXd") for _ in range(rng.randrange(30)))
        assert rp.repair(word) == cheapest(symbols(word)), word


def test_prices_end_exact():
    arcs = rp.lattice("suuaA", rp.DONE, True)
    prices = [0] * (len(arcs) + 1)
    assert rp.auction(arcs, prices, rp.START) == cheapest(symbols("suuaA"))[0]
    assert all(prices[i] <= cost + prices[j] for i, out in enumerate(arcs) for _, cost, j in out)


def talk(seed, convs, most):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \t", "Yes. ", "多い。", "ends here.\n", None]
    roles = ["user", "assistant", "system", "tool", "", "User", None]
    rows = []
    for c in [*range(convs), None]:
        for t in range(rng.randrange(1, most)):
            turn = None if rng.random() < 0.1 else t + (t > 3) * 2
            rows += [(c, turn, rng.choice(roles[:2] if rng.random() < 0.7 else roles), rng.choice(texts[:3] if rng.random() < 0.6 else texts))] * rng.choice([1, 1, 1, 3])
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "z", "z") for r in rows], "conv_id long, turn long, role string, text string, n string, part string")


def test_conversations(spark):
    rows = talk(1, 150, 12)
    assert sorted(map(tuple, rp.repair_conversations(rp.damaged(frame(spark, rows))).collect()), key=repr) == plain(rows)


def test_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(rp, "LONG", 8)
    rows = talk(4, 40, 60) + [(77, None, None, None)] * 30 + [(78, 4, "user", "the same.")] * 50
    assert sorted(map(tuple, rp.repair_conversations(rp.damaged(frame(spark, rows).repartition(5))).collect()), key=repr) == plain(rows)


def test_empty(spark):
    assert rp.repair_conversations(rp.damaged(frame(spark, []))).count() == 0


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_given_table(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, rp.repair_conversations(rp.damaged(table)).collect()), key=repr) == plain(rows)
