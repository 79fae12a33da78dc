import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from clustervitals.llm import queries, trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, place string, digest int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, sha(f"{len(role)}:{role}{text}"), role, text))
    plain = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, turns in plain.items():
        h = zlib.crc32(str(c).encode()) % 4
        first = c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = plain.get(first, [])[:h] + turns[h:]
    return out


def brute(rows):
    """The nodes by walking every prefix of every conversation."""
    whole = rebuilt(rows)
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(set)
    for p in members:
        if p:
            children[p[:-1]].add(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, cs in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(cs) - 1) * words
            leaves[p[:d]] += not children[p]
    return sorted(
        (min(cs), len(p), min(members[p[:-1]]) if p else -1, len(cs), len(children[p]), leaves[p], saved[p],
         sha(",".join(str(c) for c in sorted(cs) if len(whole[c]) == len(p))))
        for p, cs in members.items()
    )


def nodes(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    turns = trie.numbered_turns(df)
    shared = F.crc32(F.col("conv").cast("string").cast("binary")) % 4
    found = trie.prefix_trie(*trie.with_shared_start(turns, 20, shared, 3))
    assert found.columns == COLUMNS
    return sorted(tuple(-1 if v is None else v for v in r) for r in found.collect())


def some_rows(seed, n_convs, n_texts):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-30, 60), n_convs):
        for t in range(rng.randint(1, 6)):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", "assistant", None]), rng.choice([None, "", "a b", " x\ny\x1fz ", "é 中"][:n_texts])))
    rng.shuffle(rows)
    return rows + rows[:2]


@pytest.mark.parametrize("seed, n_convs, n_texts, block", [(1, 40, 2, 4096), (2, 40, 5, 2), (3, 5, 5, 1)])
def test_nodes_equal_brute_force(spark, monkeypatch, seed, n_convs, n_texts, block):
    monkeypatch.setattr(trie, "BLOCK", block)
    monkeypatch.setattr(trie, "ENDS_BLOCK", 7)
    rows = some_rows(seed, n_convs, n_texts)
    assert nodes(spark, rows) == brute(rows)


def test_no_rows_null_conversations_and_turnless_ones(spark):
    assert nodes(spark, []) == []
    assert nodes(spark, [(None, 1, "user", "a")]) == []
    # 13 takes its first turns from 0, which does not exist; its checksum says how many of its own go.
    alone = [(13, 0, "user", "a b c")]
    assert nodes(spark, alone) == brute(alone)
    copies = [(20 * k, 0, "user", "same words") for k in range(1500)]
    assert nodes(spark, copies) == brute(copies)


def test_a_conversation_of_very_many_turns_and_a_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 64)
    rows = [(40, k, "user", f"turn {k}") for k in range(700)] + [(60, k, "user", f"turn {k}") for k in range(500)]
    rows.append((80, 0, "user", "word " * 400_000))
    assert nodes(spark, rows) == brute(rows)


def test_query_equals_brute_force_on_given_tables(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in queries.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    found = queries.QUERIES["op13_prefix_trie"](spark, sf_dir).collect()
    assert sorted(tuple(-1 if v is None else v for v in r) for r in found) == brute(rows)
