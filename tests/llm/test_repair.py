"""Conversation repair against a plain dynamic programme over whole strings."""

import hashlib
import random
import re
import zlib

import pytest

from donorlens.llm import queries, repair
from tests.llm.conftest import SMALL

SPACE = " \t\n\x0b\x0c\r"
STEP = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def damaged(rows):
    def named(v):
        return " " if v is None else str(v)

    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        kind = zlib.crc32(f"{named(conv)}:{named(turn)}".encode()) % 20
        role, text = named(role), named(text)
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit, lines) of (must go, truncated, role, text): states keep whole strings."""
    def inserted(labels):
        labels = dict(labels)
        for _ in range(3):
            for state, (cost, audit, lines) in list(labels.items()):
                for role in ("user", "assistant"):
                    to, new = STEP.get((state, role[0])), (cost + 3, audit + "I", (*lines, f"{role}:"))
                    if to and (to not in labels or new[:2] < labels[to][:2]):
                        labels[to] = new
        return labels

    labels = {"0": (0, "", ())}
    for must_go, cut, role, text in rows:
        ways = []
        for state, (cost, audit, lines) in inserted(labels).items():
            ways.append((state, (cost + 4, audit + "D", lines)))
            if not must_go:
                if to := STEP.get((state, role[:1])):
                    ways.append((to, (cost + 3 * cut, audit + "K", (*lines, f"{role}:{text}"))))
                for new in ("user", "assistant"):
                    if to := STEP.get((state, new[0])):
                        ways.append((to, (cost + 3 + 3 * cut, audit + "R", (*lines, f"{new}:{text}"))))
        labels = {}
        for state, way in ways:
            labels[state] = min(labels.get(state, way), way, key=lambda w: w[:2])
    labels = inserted(labels)
    return min((labels[s] for s in ("0", "a") if s in labels), key=lambda w: w[:2])


def brute(rows):
    out = []
    for conv, kept in damaged(rows).items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults, counts = set(), [], [0, 0, 0]
        for _, role, text in kept:
            body = text.rstrip(SPACE)
            kind = 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else 3
            if kind < 3:
                counts[kind] += 1
            faults.append((kind < 2, kind == 2, role, text))
            seen.add((role, text))
        initials = [role[:1] for _, role, _ in kept]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, lines = cheapest(faults)
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def made_rows(rng, conv, n):
    rows = []
    for k in range(n):
        turn = rng.choice([None, rng.randint(0, n)]) if rng.random() < 0.3 else k
        text = rng.choice(["a.", "b!", "c", "d? ", " ", "", "e.\n", "f", "g."]) + (f"{rng.randint(0, 30)}." if rng.random() < 0.6 else "")
        rows.append((conv, turn, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "User", "", None]), None if rng.random() < 0.05 else text))
    return rows


def test_search_from_both_ends_finds_the_least_audit():
    rng = random.Random(2)
    for _ in range(1500):
        rows = []
        for _ in range(rng.randint(0, 9)):
            rows += [(True, False, "x", "")] * rng.randint(1, 3) if rng.random() < 0.2 else [(False, rng.random() < 0.3, rng.choice(["s", "u", "a", "x", ""]), "")]
        facts = repair.Rows()
        for must_go, cut, role, _ in rows:
            facts._must_go(1) if must_go else facts.tokens.append((role, cut, 0))
        want = cheapest(rows)[:2]
        assert repair.search(facts.tokens, [repair.NOTHING], repair.ENDS, True) == want, rows
        assert [repair.solve(facts.tokens, block) for block in (1, 2, 3)] == [want] * 3, rows


def test_query_rows(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, queries.op12_conversation_repair(spark, SMALL).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("options", [{}, {"long_rows": 0, "block_rows": 2}, {"long_rows": 8, "block_rows": 5}, {"long_bytes": 20, "block_rows": 3}])
def test_odd_conversations(spark, options):
    rng = random.Random(6)
    rows = [r for conv in [None, *range(60)] for r in made_rows(rng, conv, rng.randint(1, 30))]
    rows += [(100, None, "user", "same.")] * 70 + [(101, 3, "assistant", None)] * 4 + [(102, 0, None, "x" * 100_000)]
    extra = [(*r, "s", 1) for r in rows]
    table = spark.createDataFrame(extra, "conv_id long, turn long, role string, text string, name string, n int").repartition(3)
    got = repair.repair(repair.damaged_rows(table), **options)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_one_conversation_with_most_rows_is_dealt_over_tasks(spark):
    rng = random.Random(8)
    rows = made_rows(rng, 1, 900) + made_rows(rng, 2, 6)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = repair.repair(repair.damaged_rows(table), long_rows=50, block_rows=16).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_empty_table_and_dropped_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert repair.repair(repair.damaged_rows(spark.createDataFrame([], schema))).count() == 0
    dropped = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    got = repair.repair(repair.damaged_rows(spark.createDataFrame([(7, dropped, "user", "a.")], schema))).collect()
    assert [tuple(r) for r in got] == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
