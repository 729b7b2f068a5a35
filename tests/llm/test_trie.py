"""The prefix trie against a plain walk, in one task and by jumping."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from weirflow.llm import trie


def plain(rows):
    """All nodes by dictionaries of prefixes."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            mark = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(conv, []).append((turn is not None, turn or 0, mark, len(text)))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    members = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    weight = lambda k: (len(members[k]) - 1) * (k[-1][1] if k else 0)
    out = []
    for k, who in members.items():
        below = [b for b in members if b[: len(k)] == k]
        leaf = lambda b: not any(len(x) == len(b) + 1 and x[: len(b)] == b for x in below)
        ids = ",".join(map(str, sorted(c for c in who if len(whole[c]) == len(k))))
        out.append((min(who), len(k), min(members[k[:-1]]) if k else None, len(who), sum(len(b) == len(k) + 1 for b in below), sum(map(leaf, below)), sum(map(weight, below)), hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=repr)


def odd_rows(n, seed):
    draw = random.Random(seed)
    text = lambda: draw.choice(["a", "bb", "", None, "é漢", "a long text"])
    rows = [(draw.choice([0, 1, 2, 3, 5, 100, 101, 102, 150, 250, 251, None]) if i % 4 else i, draw.choice([None, 0, 1, 1, 2, 3, 4, 5]), draw.choice(["user", "assistant", None]), text()) for i in range(n)]
    return rows + rows[:5] + [(c, 0, "user", "hot") for c in range(300, 360)]


def of(spark, rows, few=10_000):
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"place": F.lit("x"), "hash": F.lit(1), "next": F.lit(2)})
    found = trie.prefix_trie(*trie.rebuilt(trie.turns_of(table.repartition(3))), few=few)
    return found, sorted((tuple(r)[:-1] for r in found.collect()), key=repr)


@pytest.mark.parametrize("few", [10_000, 8])
def test_nodes_are_those_of_a_plain_walk(spark, few, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 3)
    monkeypatch.setattr(trie, "RULERS", 4)
    monkeypatch.setattr(trie, "ID_BITS", 2)
    rows = odd_rows(160, 7)
    assert of(spark, rows, few)[1] == plain(rows)


def test_positions_follow_the_tour(spark):
    found, _ = of(spark, odd_rows(60, 9))
    rows = found.collect()
    at = {(r.conv_id, r.depth): r.position for r in rows}
    assert min(at.values()) == 1 and len(set(at.values())) == len(rows)
    assert all(at[r.parent_conv_id, r.depth - 1] < at[r.conv_id, r.depth] for r in rows if r.depth)


def test_empty_table_and_one_row(spark):
    assert of(spark, [])[1] == [] and of(spark, [(None, 1, "user", "x")])[1] == []
    rows = [(7, None, None, None)]
    assert of(spark, rows)[1] == plain(rows)
