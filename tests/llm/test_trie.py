from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from minewright.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def digest(role, text):
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def brute(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, digest(role or "", text or ""), (role or "", text or "")))
    own = {c: [x[3] for x in sorted(t)] for c, t in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        built[c] = own.get(base, [])[:h] + turns[h:]
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for k in nodes:
        if k:
            kids.setdefault(k[:-1], []).append(k)

    def below(k):
        leaves, saved = int(k not in kids), (len(nodes[k]) - 1) * len(k[-1][1]) if k else 0
        for x in kids.get(k, []):
            more = below(x)
            leaves, saved = leaves + more[0], saved + more[1]
        return leaves, saved

    out = []
    for k, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(built[c]) == len(k))))
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), len(kids.get(k, [])), *below(k), hashlib.sha256(ends.encode()).hexdigest()))
    return out


def plain(rows):
    return sorted(tuple(-(10**9) if x is None else x for x in r) for r in rows)


def check(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS key", "2 AS depth", "'x' AS parent").repartition(3)
    found = trie.trie(df, **options)
    assert found.columns == NAMES
    assert plain(tuple(r) for r in found.collect()) == plain(brute(rows))


def random_rows(seed, convs, texts, longest):
    rng = random.Random(seed)
    rows = [(c, rng.choice([None, 1, 2, t, t, t]), rng.choice(["user", "assistant", None, ""]), rng.choice(texts)) for c in convs for t in range(rng.randint(1, longest))]
    return rows + rng.sample(rows, len(rows) // 9) + [(None, 1, "user", "x")]


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    check(spark, random_rows(seed, range(-3, 240, 2 - seed % 2), ["a", "bb", "é€😀", "", None], 7))


def test_hot_first_turn_and_equal_conversations_span_shards(spark):
    rows = [(c, t, "user", f"t{t}" if c % 3 else f"t{t}x{c % 7 if t > 2 else 0}") for c in range(1, 400) for t in range(4)]
    check(spark, rows, shard_rows=13)


def test_conversations_longer_than_a_block(spark):
    rng = random.Random(4)
    rows = [(c, t, "user", "same" if t < 70 + 13 * (c % 4) else rng.choice("ab")) for c in range(0, 9) for t in range(rng.choice([3, 80, 150]))]
    check(spark, rows, shard_rows=4)


def test_turnless_conversations_and_one_conversation(spark):
    lone = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 == 5)
    check(spark, [(lone, 1, "user", "a"), (lone, 2, "user", "b")])
    check(spark, [(100, 1, None, None)])


def test_empty_table(spark):
    assert trie.trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_rows_are_sorted_like_lists():
    rng = np.random.default_rng(2)
    seqs = [list(rng.integers(0, 2, rng.choice([0, 3, 64, 65, 200]))) for _ in range(60)]
    seqs += [s[:70] for s in seqs if len(s) > 70] + seqs[:10]
    ids = rng.permutation(len(seqs))
    size = np.array([len(s) for s in seqs])
    order = trie.sorted_rows(size, np.cumsum(size) - size, np.concatenate([np.array(s, np.int64) for s in seqs]), ids)
    assert [int(i) for i in order] == sorted(range(len(seqs)), key=lambda i: ([int(x) for x in seqs[i]], ids[i]))
