"""Nearest neighbours, fill-in-middle and conversation repair against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import conversation, fill_middle, neighbours
from sparkloom.llm import queries as Q

SF = "/root/testdata/sf0.1"


# --- nearest neighbours ---


def plain_nearest(rows, k=20):
    """{query id: [(vec id, score)]} over rows (id, vector), all compared."""
    able = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q in {i for i, _ in able if i % 20 == 0}:
        best = {}
        for own in (v for i, v in able if i == q):
            for i, v in able:
                if i != q and len(v) == len(own):
                    best[i] = max(best.get(i, -np.inf), float((v * own).sum()))
        out[q] = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
    return {q: x for q, x in out.items() if x}


def found(df):
    out = {}
    for r in sorted(df.collect()):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def test_recall_of_the_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want, got = plain_nearest(rows), found(Q.op11_neighbours(spark, SF))
    assert set(got) == set(want) and all(len(x) == 20 for x in got.values())
    scores = {q: dict(x) for q, x in want.items()}
    assert all(abs(scores[q].get(i, s) - s) < 1e-12 for q, x in got.items() for i, s in x)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.93


def test_neighbours_of_odd_vectors(spark):
    rng = random.Random(5)
    vector = lambda n: [rng.uniform(-1, 1) for _ in range(n)]
    same = vector(4)
    rows = [(i, same) for i in range(60)] + [(100 + i, vector(4)) for i in range(30)] + [(0, vector(4)), (20, same), (200, [x * 50 for x in same]), (220, vector(3)), (221, vector(3)), (240, vector(2))]
    rows += [(300, None), (320, []), (340, [0.0] * 4), (360, [1.0, None, 1.0, 1.0]), (380, [1.0, float("nan"), 0.0, 0.0]), (400, [float("inf"), 1.0, 1.0, 1.0]), (None, same)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumns({c: F.lit("own") for c in ("id", "v", "d", "region", "bucket", "score", "rank")})
    assert found(neighbours.nearest(df, F.col("vec_id") % 20 == 0)) == plain_nearest(rows)
    assert neighbours.nearest(df.where("vec_id is null"), F.col("vec_id") % 20 == 0).collect() == []
    assert neighbours.nearest(df.where("vec_id = 0"), F.col("vec_id") % 20 == 0).collect() == neighbours.nearest(df.where("vec_id = 1"), F.col("vec_id") % 20 == 0).collect() == []


def test_blocks_and_stepwise_visits(spark, monkeypatch):
    """Regions split into blocks, and few rows at once, change nothing; buckets come in the order of their chances."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((6, 8))
    rows = [(i, (centres[i % 6] + 0.05 * rng.standard_normal(8)).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    whole = found(neighbours.nearest(df, F.col("vec_id") % 20 == 0))
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 1 << 30)
    assert found(neighbours.nearest(df, F.col("vec_id") % 20 == 0)) == whole
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 3)
    assert found(neighbours.nearest(df, F.col("vec_id") % 20 == 0)) == whole
    index = neighbours.Index(1.0, 0.7, 1.9, rng.standard_normal((1, 9, 5)), rng.uniform(size=(1, 5)), 2, 40, 1.0)
    slots = index.slots(rng.standard_normal((7, 8)), as_queries=True)[0]
    for own, visited in zip(slots, index.visits(slots, 40), strict=True):
        low = lambda step, own=own: (np.floor(own) + step - own) * index.width / index.distance
        loss = {s: -np.log(neighbours._normal(low(s) + index.width / index.distance) - neighbours._normal(low(s))) for s in (-1, 0, 1)}
        every = sorted(sum(loss[s][f] for f, s in enumerate(steps)) for steps in np.ndindex(3, 3, 3, 3, 3) for steps in [[x - 1 for x in steps]])
        mine = [sum(loss[int(h - np.floor(own[f]))][f] for f, h in enumerate(v)) for v in visited]
        assert np.allclose(mine, every[:40])


# --- fill-in-middle ---


def plain_fill(name, text, unit=r"(?s:.)", marks=("<P>", "<S>", "<M>")):
    text = text or ""
    ends = [0] + [m.end() for m in re.finditer(unit, text)]
    n = len(ends) - 1
    x = hashlib.sha256(f"1:{'' if name is None else name}".encode()).hexdigest()
    h = [int(x[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not n or any(m in text for m in marks) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = (ends[r] for r in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    p, m, s = marks[0] + text[:a], marks[2] + text[a:b], marks[1] + text[b:]
    return (n, "spm", a, b - a, s + p + m) if h[3] % 100 < 20 else (n, "psm", a, b - a, p + s + m)


@pytest.mark.parametrize("unit", [r"(?s:.)", r"[^\s]+\s*", r"[^\n]*\n|[^\n]+"])
def test_fill_middle(spark, unit):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a", " ", "é", "\n", "𝔘", "<", ".", "\x00"]) for _ in range(rng.randrange(40))) for _ in range(300)] + ["", None, "x<P>y", "<S>", "a<M", "w" * 3_000_000, "end <M>"]
    rows = [(i if i % 17 else None, t) for i, t in enumerate(texts)] + [(7, texts[7])] * 2
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit("own") for c in ("key", "n", "form", "output", "prefix_chars")})
    made = fill_middle.transform(df, fill_middle.Settings(unit=unit))
    got = made.withColumn("back", fill_middle.restored()).collect()
    key = lambda r: (r[0] is None, r[0] or 0, str(r))
    assert sorted((tuple(r[:6]) for r in got), key=key) == sorted(((i, *plain_fill(i, t, unit)) for i, t in rows), key=key)
    assert sorted(r["back"] for r in got) == sorted(t or "" for _, t in rows)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.transform(df.where("false")).collect() == []


# --- conversations ---

ORDER = re.compile(r"(s?(ua)+)?")


def plain_repair(roles, faults):
    """Least (cost, audit) by a forward table of the best (cost, audit) of each state."""
    def better(table, state, cost, audit):
        if state is not None and ((cost, audit) < table.get(state, (10**9, ""))):
            table[state] = (cost, audit)

    def goes(state, initial):
        return {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}.get((state, initial))

    def fresh(table):
        for _ in range(4):
            for state, (cost, audit) in list(table.items()):
                for initial in "ua":
                    better(table, goes(state, initial), cost + 3, audit + "I")
        return table

    table = {0: (0, "")}
    for role, fault in zip(roles, faults, strict=True):
        after = {}
        for state, (cost, audit) in fresh(table).items():
            better(after, state, cost + 4, audit + "D")
            if fault not in (1, 2):
                extra = 3 * (fault == 3)
                better(after, goes(state, role), cost + extra, audit + "K")
                for initial in "ua":
                    better(after, goes(state, initial), cost + 3 + extra, audit + "R")
        table = after
    return min(x for state, x in fresh(table).items() if state in (0, 3))


def every_repair(roles, faults):
    """The same by trying all edit sequences up to a few letters more than turns."""
    best = (10**9, "")
    stack = [(0, 0, "", "")]
    while stack:
        at, cost, audit, out = stack.pop()
        if cost > best[0] or len(audit) > len(roles) + 4:
            continue
        if at == len(roles) and ORDER.fullmatch(out):
            best = min(best, (cost, audit))
        stack += [(at, cost + 3, audit + "I", out + x) for x in "ua"]
        if at < len(roles):
            stack.append((at + 1, cost + 4, audit + "D", out))
            if faults[at] not in (1, 2):
                extra = 3 * (faults[at] == 3)
                stack.append((at + 1, cost + extra, audit + "K", out + roles[at]))
                stack += [(at + 1, cost + 3 + extra, audit + "R", out + x) for x in "ua"]
    return best


def packed(roles, faults):
    return bytes(f + 4 * ("sua".index(r) if r in "sua" else 3) for r, f in zip(roles, faults, strict=True))


def test_least_repairs():
    rng = random.Random(2)
    for n in [*range(5)] * 25:
        roles, faults = [rng.choice("suax") for _ in range(n)], [rng.choice((0, 0, 0, 1, 2, 3)) for _ in range(n)]
        assert conversation.repair(packed(roles, faults)) == plain_repair(roles, faults) == every_repair(roles, faults), (roles, faults)
    for n in [*range(30)] * 20:
        roles, faults = [rng.choice("suaauuax") for _ in range(n)], [rng.choice((0, 0, 0, 0, 1, 2, 3)) for _ in range(n)]
        assert conversation.repair(packed(roles, faults)) == plain_repair(roles, faults), (roles, faults)


@pytest.mark.parametrize("stretch", [1, 2, 7, 256])
def test_repairs_in_stretches(monkeypatch, stretch):
    monkeypatch.setattr(conversation, "STRETCH", stretch)
    rng = random.Random(stretch)
    for n in [0, 1, 2, 3, 5, 9, 40, 300, 700] * 4:
        roles, faults = [rng.choice("suaaux") for _ in range(n)], [rng.choice((0, 0, 0, 1, 2, 3)) for _ in range(n)]
        assert conversation.repair(packed(roles, faults)) == plain_repair(roles, faults)


def plain_conversations(rows):
    """{conv_id: result} with the damage of the query."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            say = lambda x: " " if x is None else str(x)
            fate = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20
            text = "" if fate == 1 else re.sub("[.!?]", "", say(text)) if fate == 2 else say(text)
            turns += [(turn, "user" if fate == 4 else say(role), text)] * {0: 0, 3: 2}.get(fate, 1)
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.md5(t[2].encode()).hexdigest()))
        faults, seen = [], set()
        for _, role, text in turns:
            last = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)[-1:]
            faults.append(1 if not last else 2 if (role, text) in seen else 3 if last not in ".!?" else 0)
            seen.add((role, text))
        roles = [role[:1] for _, role, _ in turns]
        cost, audit = plain_repair(roles, faults)
        lines, state, own = [], "", iter(turns)
        for letter in audit:
            _, role, text = (None, None, "") if letter == "I" else next(own)
            if letter in "RI":
                role = "assistant" if state == "u" else "user"
            if letter != "D":
                state = role[:1]
                lines.append(f"{role}:{text}")
        told = [t for t, _, _ in turns if t is not None]
        gaps = max(told) - min(told) + 1 - len(set(told)) if told else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
        out[conv] = (gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def test_conversations(spark):
    rng = random.Random(9)
    rows = []
    for conv in [*range(60), None, -5]:
        for _ in range(rng.randrange(1, 14)):
            rows.append((conv, rng.choice([None, *range(9)]), rng.choice(["user", "user", "assistant", "assistant", "system", "tool", "", None]), rng.choice(["a.", "b!", "c", "\t ", "", None, "d?\n", "é. x", "long. " * 900])))
    rows += [(conv, 0, "user", "dropped?") for conv in range(1000, 1200) if zlib.crc32(f"{conv}:0".encode()) % 20 == 0]
    rows += [(77, t, ("user", "assistant")[t % 2], f"turn {t % 50}.") for t in range(900)] + [(78, 3, "user", "same.")] * 200
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({c: F.lit(1) for c in ("copies", "audit", "digest", "kind", "is_turn", "place", "first")})
    got = {r.conv_id: tuple(r)[1:] for r in conversation.repaired(conversation.damaged(df)).collect()}
    want = plain_conversations(rows)
    assert got == want
    assert sum(x == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for x in want.values()) > 3 and len(want[77][6]) > 256
    edits = {}
    for r in sorted(conversation.edits(conversation.damaged(df)).collect(), key=lambda r: r.place):
        edits.setdefault(r.conv_id, []).append(r)
    for conv, x in edits.items():
        kept = [r for r in x if r.edit != "D"]
        assert "".join(r.edit for r in x) == want[conv][6] and hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in kept).encode()).hexdigest() == want[conv][7]
        assert ORDER.fullmatch("".join(r.role[:1] for r in kept))
    assert conversation.repaired(df.where("false").drop("copies")).collect() == []
