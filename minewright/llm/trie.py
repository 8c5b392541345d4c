"""Conversation prefix trie: padded turn-id matrices in sorted shards, whose boundary nodes are recombined."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minewright.llm.common import Scratch

#: Bytes of a turn's digest in a conversation's key.
DIGEST = 16
#: Columns of a padded matrix that are looked at together.
BLOCK = 64
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODES = pa.schema(
    [(c, pa.int64()) for c in ("depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "own_tokens")]
    + [("key", pa.binary()), ("parent", pa.binary()), ("ends", pa.string())]
)


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and turns, an array of (digest, chars) in order of turn, nulls first, equal turns by their digests.

    turns: conv_id, turn, role, text; null roles and texts are empty. Texts stay where they are: a turn is the digest of its role
    and text and the number of code points. Null conv_ids are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    known = turns.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.char_length(text).cast("long").alias("chars"))
    one = F.struct(F.col("turn").isNotNull().alias("numbered"), "turn", "digest", "chars")
    return known.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("all")).select("conv_id", F.transform("all", lambda x: F.struct(x.digest.alias("digest"), x.chars.alias("chars"))).alias("turns"))


def rebuild(convs: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """conv_id and turns: the first h turns of conversation conv_id - conv_id % every, then its own after the first h; h = crc32(conv_id) % most."""
    c = F.col("conv_id")
    own = convs.select("conv_id", "turns", (c - c % every).alias("base"), (F.crc32(c.cast("string").cast("binary")) % most).cast("int").alias("h"))
    bases = convs.filter(c % every == 0).select(c.alias("base"), F.slice("turns", 1, most - 1).alias("lead"))
    lead = F.slice(F.coalesce("lead", F.array().cast(convs.schema["turns"].dataType)), F.lit(1), F.col("h"))
    return own.join(bases, "base", "left").select("conv_id", F.concat(lead, F.filter("turns", lambda _, i: i >= F.col("h"))).alias("turns"))


def turn_ids(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(turns of each conversation, place of its first one, id of each turn): equal turns have equal ids, from 0."""
    size = np.array([len(k) for k in keys], np.int64)
    flat = np.concatenate([np.zeros((0, DIGEST), np.uint8), *keys]).view(f"S{DIGEST}").ravel()
    return size, np.cumsum(size) - size, np.unique(flat, return_inverse=True)[1].astype(np.int64).ravel()


def padded(size: np.ndarray, at: np.ndarray, number: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, matrix): BLOCK columns from `first` of the turn ids of the rows that reach into them, padded with -1.

    Only these rows are padded, so all blocks together hold at most BLOCK cells a row more than there are turns.
    """
    rows = np.flatnonzero(size > first)
    cell = first + np.arange(BLOCK)
    there = cell[None, :] < size[rows, None]
    return rows, np.where(there, number[np.where(there, at[rows, None] + cell, 0)], -1)


def sorted_rows(size: np.ndarray, at: np.ndarray, number: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The order of the rows by their turn ids, a prefix before what it begins, then by id.

    numpy's lexsort of each block, the last one first: a row's rank among the later columns is the least of its keys.
    """
    rank = np.zeros(len(size), np.int64)
    for first in reversed(range(0, int(size.max(initial=0)), BLOCK)):
        rows, m = padded(size, at, number, first)
        by = np.lexsort((rank[rows], *m.T[::-1]))
        m, r = m[by], rank[rows[by]]
        new = (m[1:] != m[:-1]).any(1) | (r[1:] != r[:-1])
        rank = np.zeros(len(size), np.int64)
        rank[rows[by]] = 1 + np.concatenate([[0], np.cumsum(new)])
    return np.lexsort((ids, rank))


def changes(size: np.ndarray, at: np.ndarray, number: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each block of sorted rows (rows, mask): mask[r, j] is whether row r differs from the one before in its first j + 1 columns or earlier ones."""
    out, group = [], np.zeros(len(size), np.int64)
    for first in range(0, int(size.max(initial=0)), BLOCK):
        rows, m = padded(size, at, number, first)
        differ = np.ones(m.shape, bool)
        differ[1:] = m[1:] != m[:-1]
        differ[1:, 0] |= group[rows[1:]] != group[rows[:-1]]
        mask = np.logical_or.accumulate(differ, axis=1)
        group[rows] = np.cumsum(mask[:, -1])
        out.append((rows, mask))
    return out


def path_keys(turns: np.ndarray) -> list[bytes]:
    """The digest of each prefix of a conversation, the empty one first."""
    out = [hashlib.sha256(b"").digest()[:DIGEST]]
    for turn in turns:
        out.append(hashlib.sha256(out[-1] + turn.tobytes()).digest()[:DIGEST])
    return out


def shard_nodes(keys: list[np.ndarray], chars: list[np.ndarray], ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The trie nodes of a shard's conversations, depth by depth, the deepest first.

    The accumulated masks of changes() mark where the nodes of each depth start, and reduceat over these starts sums up members,
    children, leaves and tokens. Nodes on the paths of the first and the last row, and the root, may go on in
    other shards: they come with a key, what is known of their complete descendants, and the ids that end in them. All
    others are complete; if the parent isn't, `parent` has its key.
    """
    size, at, number = turn_ids(keys)
    order = sorted_rows(size, at, number, ids)
    keys, chars, ids, size, at = [keys[i] for i in order], [chars[i] for i in order], ids[order], size[order], at[order]
    n = len(ids)
    masks = changes(size, at, number)
    path = path_keys(keys[0]), path_keys(keys[-1])
    # What starts at a row and is complete: leaves and tokens of all depths, children of the depth below (with incomplete ones: `below`).
    leaves, saved, inner, below = (np.zeros(n, np.int64) for _ in range(4))
    children: dict[str, np.ndarray] | None = None
    for d in range(int(size.max(initial=0)), -1, -1):
        if d:
            rows, mask = masks[(d - 1) // BLOCK]
            edge = np.flatnonzero(mask[:, (d - 1) % BLOCK])
        else:
            rows, edge = np.arange(n), np.zeros(1, np.int64)
        end = np.append(edge[1:], len(rows))
        first, last = rows[edge], rows[end - 1]
        total = lambda x: np.add.reduceat(x[rows], edge)  # noqa: B023, E731
        node = {
            "row": first, "conv_id": np.minimum.reduceat(ids[rows], edge), "n_convs": end - edge, "n_children": total(inner), "n_leaves": total(leaves),
            "saved_tokens": total(saved), "done": total((size == d).astype(np.int64)), "leaf": total(below) == 0,
            "own_tokens": np.array([chars[i][d - 1] if d and size[i] >= d else 0 for i in first], np.int64), "open": (first == 0) | (last == n - 1) | (d == 0),
        }
        held = size[first] >= d
        node = {k: v[held] for k, v in node.items()}
        if children is not None:
            yield _batch(d + 1, children, node, ids, path)
        inner[rows] = below[rows] = 0
        whole = ~node["open"]
        node["n_leaves"] = node["n_leaves"] + (node["leaf"] & whole)
        node["saved_tokens"] = node["saved_tokens"] + np.where(whole, (node["n_convs"] - 1) * node["own_tokens"], 0)
        leaves[node["row"]] += node["leaf"] & whole
        saved[node["row"]] += np.where(whole, (node["n_convs"] - 1) * node["own_tokens"], 0)
        inner[node["row"]] = whole
        below[node["row"]] = 1
        children = node
    if children is not None and n:
        yield _batch(0, children, None, ids, path)


def _batch(depth: int, node: dict[str, np.ndarray], parents: dict[str, np.ndarray] | None, ids: np.ndarray, path: tuple[list[bytes], list[bytes]]) -> pa.RecordBatch:
    """The nodes of one depth; members that end in a node stand at its first rows."""
    up = np.searchsorted(parents["row"], node["row"], "right") - 1 if parents else np.zeros(len(node["row"]), np.int64)
    key_of = lambda row, d: path[0 if row == 0 else 1][d]
    keys, above, ends = [], [], []
    for row, done, open_, p in zip(node["row"].tolist(), node["done"].tolist(), node["open"].tolist(), up.tolist(), strict=True):
        text = ",".join(map(str, ids[row : row + done].tolist()))
        keys.append(key_of(row, depth) if open_ else None)
        ends.append((text or None) if open_ else hashlib.sha256(text.encode()).hexdigest())
        above.append(key_of(int(parents["row"][p]), depth - 1) if parents and parents["open"][p] else None)
    of_parent = pa.array(parents["conv_id"][up], mask=parents["open"][up]) if parents else pa.nulls(len(up), pa.int64())
    columns = [pa.array(np.full(len(up), depth)), pa.array(node["conv_id"]), of_parent, *[pa.array(node[c].astype(np.int64)) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens", "own_tokens")]]
    return pa.RecordBatch.from_arrays([*columns, pa.array(keys, pa.binary()), pa.array(above, pa.binary()), pa.array(ends, pa.string())], schema=NODES)


def _sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's rows (conv_id, key, chars) to its nodes."""
    ids, keys, chars = [], [], []
    for batch in batches:
        ids += batch.column(0).to_pylist()
        keys += [np.frombuffer(k, np.uint8).reshape(-1, DIGEST) for k in batch.column(1).to_pylist()]
        chars += [np.array(c, np.int64) for c in batch.column(2).to_pylist()]
    if ids:
        yield from shard_nodes(keys, chars, np.array(ids, np.int64))


def _recombined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The open nodes, summed by key, to whole ones: the deepest first, each adds itself to its parent."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held)
    c = {name: rows[name].to_numpy().copy() for name in ("depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "own_tokens")}
    number = {k: i for i, k in enumerate(rows["key"].to_pylist())}
    up = np.array([-1 if p is None else number[p] for p in rows["parent"].to_pylist()], np.int64)
    # What complete nodes have is summed in each open node above them already; only open ones still have to hand themselves up.
    more = {name: np.zeros(len(up), np.int64) for name in ("n_leaves", "saved_tokens")}
    for d in range(int(c["depth"].max()), -1, -1):
        now = np.flatnonzero(c["depth"] == d)
        more["n_leaves"][now] += c["n_children"][now] == 0
        more["saved_tokens"][now] += (c["n_convs"][now] - 1) * c["own_tokens"][now]
        if d:
            np.add.at(c["n_children"], up[now], 1)
            for x in more.values():
                np.add.at(x, up[now], x[now])
    for name, x in more.items():
        c[name] += x
    parent = pa.array(np.where(up < 0, 0, c["conv_id"][up]), mask=up < 0)
    names = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    yield pa.RecordBatch.from_arrays([rows["key"].combine_chunks(), *[pa.array(c[x]) for x in ("depth", "conv_id")], parent, *[pa.array(c[x]) for x in names]], ["key", "depth", "conv_id", "parent_conv_id", *names])


def _hashed_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces (key, least, ends) in order of key and least to the hash of each key's ids; one piece at a time."""
    now, hashed = None, None
    for batch in batches:
        done = []
        for key, ends in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if key == now:
                hashed.update(b"," + ends.encode())
            else:
                if now is not None:
                    done.append((now, hashed.hexdigest()))
                now, hashed = key, hashlib.sha256(ends.encode())
        if done:
            yield pa.RecordBatch.from_pylist([{"key": k, "ends_sha256": h} for k, h in done], pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())]))
    if now is not None:
        yield pa.RecordBatch.from_pylist([{"key": now, "ends_sha256": hashed.hexdigest()}], pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())]))


def trie(turns: DataFrame, every: int = 100, most: int = 6, shard_rows: int = 100_000) -> DataFrame:
    """The prefix trie of rebuilt conversations (see rebuild()), a row per node: conv_id (its smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversations are dealt to shards by range of their whole turn sequence and id, so one that very many share, or a
    first turn that most have, is spread over shards like all others. A shard is built in numpy (see
    shard_nodes()). Its nodes are complete but for two paths, those of its first and last row; these partial nodes are summed by
    key and completed in one small task, of two paths per shard. Complete nodes under a partial parent look its
    smallest member up. The ids that end in a partial node are hashed as a stream of pieces, one per shard.

    Null conv_ids are left out, null turns come first, equal turns are ordered by the md5 of role and text; repeated rows are turns of
    their own. Null roles and texts are empty. Texts of any length never leave their row: a turn counts 16 bytes and its length from there
    on. The turns of one conversation must fit into a row that way. Without conversations there are no nodes. Other columns are
    ignored, whatever their names.
    """
    spark = turns.sparkSession
    scratch = Scratch(spark, "trie")
    convs = scratch.keep(conversations(turns.select("conv_id", "turn", "role", "text")), "conversations")
    key = F.unhex(F.array_join(F.transform("turns", lambda x: x.digest), ""))
    rebuilt = scratch.keep(rebuild(convs, every, most).select("conv_id", key.alias("key"), F.transform("turns", lambda x: x.chars).alias("chars")), "rebuilt")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rebuilt.count() // shard_rows))
    kinds = {pa.int64(): "long", pa.binary(): "binary", pa.string(): "string"}
    schema = ", ".join(f"{f.name} {kinds[f.type]}" for f in NODES)
    nodes = scratch.keep(rebuilt.repartitionByRange(parts, "key", "conv_id").mapInArrow(_sharded, schema), "nodes")
    part = nodes.filter("key IS NOT NULL")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    summed = part.groupBy("key").agg(F.any_value("parent").alias("parent"), F.any_value("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *sums, F.any_value("own_tokens").alias("own_tokens"))
    whole = summed.coalesce(1).mapInArrow(_recombined, "key binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long")
    whole = scratch.keep(whole, "whole")
    pieces = part.filter("ends IS NOT NULL").select("key", F.split("ends", ",", 2)[0].cast("long").alias("least"), "ends")
    ends = pieces.repartition("key").sortWithinPartitions("key", "least").mapInArrow(_hashed_ends, "key binary, ends_sha256 string")
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    border = whole.join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS))).select(*names)
    inside = nodes.filter("key IS NULL").withColumnRenamed("ends", "ends_sha256")
    below = inside.filter("parent IS NOT NULL").drop("parent_conv_id").join(whole.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent")
    return scratch.done(inside.filter("parent IS NULL").select(*names).unionByName(below.select(*names)).unionByName(border))


ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, md5(strlen(r) || ':' || r || x) AS g, length(x) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(r) || ':' || r || x)) AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)
), h AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
         xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
             lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)
), r AS (
  SELECT h.conv_id, 0 AS part, pos, g, n FROM h JOIN t ON t.conv_id = h.base AND pos <= h
  UNION ALL SELECT h.conv_id, 1, pos, g, n FROM h JOIN t ON t.conv_id = h.conv_id AND pos > h
), s AS (
  SELECT h.conv_id, coalesce(list(g ORDER BY part, pos) FILTER (g IS NOT NULL), []) AS gs, coalesce(list(n ORDER BY part, pos) FILTER (g IS NOT NULL), []) AS ns FROM h LEFT JOIN r USING (conv_id) GROUP BY h.conv_id
), node AS (
  SELECT d, gs[1:d] AS k, min(conv_id) AS conv_id, count(*) AS n, coalesce(any_value(ns[d]), 0) AS own, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(gs) = d) AS ends
  FROM (SELECT *, unnest(range(len(gs) + 1)) AS d FROM s) GROUP BY 1, 2
), kids AS (
  SELECT d - 1 AS d, k[1:d - 1] AS k, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1, 2
), full_node AS (
  SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids ON kids.d = node.d AND kids.k = node.k
), tree AS (
  SELECT a AS d, k[1:a] AS k, count(*) FILTER (n_children = 0) AS n_leaves, sum((n - 1) * own) AS saved_tokens FROM (SELECT *, unnest(range(d + 1)) AS a FROM full_node) GROUP BY 1, 2
)
SELECT x.conv_id, x.d AS depth, p.conv_id AS parent_conv_id, x.n AS n_convs, x.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(x.ends, '')) AS ends_sha256
FROM full_node x JOIN tree ON tree.d = x.d AND tree.k = x.k LEFT JOIN node p ON p.d = x.d - 1 AND p.k = x.k[1:x.d - 1]
"""
