"""Suffix-array dedup: maximal repeats from the common-prefix interval trees of sampled suffixes.

Any string of `length` bytes has one anchor in it: the start of its seed (`seed` bytes) with the least
hash, the leftmost of equal ones. That depends on the string's bytes alone, so equal strings have equal
seeds at equal places. Suffixes are therefore taken at anchors only, and dealt to tasks by their seed;
the suffix arrays of different seeds share no string of that length and are scanned apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minewright.llm import textnum as tn
from minewright.llm.common import join_groups, materialize

U64 = np.uint64
PLACE = U64((1 << 24) - 1)
SLICE = 8 << 20


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return values if span == width else np.minimum(values[: len(values) - (width - span)], values[width - span :])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, first, last, seed hash) of the anchors in some texts, in order.

    first and last: the starts of the strings of `length` bytes within one text that have this anchor.
    """
    none = np.zeros(0, np.int64)
    parts = []
    for a in range(0, len(data), SLICE):  # strings that start in a slice
        b = min(len(data), a + SLICE + length - 1)
        part = data[a:b]
        if len(part) < length:
            break
        sums = tn.prefix_sums(part)
        at = np.arange(len(part) - seed + 1)
        h = tn.span_hashes(sums, at, at + seed)
        where = (_least(h & ~PLACE | at.astype(np.uint64), length - seed + 1) & PLACE).astype(np.int64)
        inside = np.ones(len(where), bool)
        for cut in offsets[np.searchsorted(offsets, a, "right") : np.searchsorted(offsets, b, "left")] - a:
            inside[max(0, cut - length + 1) : cut] = False
        start = np.flatnonzero(inside)
        where = where[start]
        if len(start):
            new = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]) | (start[1:] != start[:-1] + 1)]))
            last = np.concatenate([start[new[1:] - 1], start[-1:]])
            parts.append((where[new] + a, start[new] + a, last + a, h[where[new]]))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (none, none, none, np.zeros(0, np.uint64))


def _list(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *values])))


def _sampled(docs: DataFrame, length: int, seed: int) -> DataFrame:
    """id, n, sha, keys, marks: the seeds' hashes and place << 32 | bytes to first << 16 | bytes to last."""
    if not 0 < seed <= length <= seed + 0xFFFF:
        raise ValueError(f"a seed of {seed} bytes doesn't fit strings of {length}: at most 65535 more")

    def work(batches):
        for batch in batches:
            sizes, digests, keys, marks = [], [], [], []
            for chunk in tn.chunks(batch.column(1)):
                place, first, last, h = anchors(chunk.data, chunk.offsets, length, seed)
                cut = np.searchsorted(place, chunk.offsets)
                mark = (place - chunk.offsets[np.searchsorted(chunk.offsets, place, "right") - 1]) << 32 | (place - first) << 16 | (place - last)
                for i in range(len(chunk)):
                    own = chunk.data[chunk.offsets[i] : chunk.offsets[i + 1]]
                    sizes.append(len(own))
                    digests.append(hashlib.sha256(own).hexdigest())
                    keys.append(h[cut[i] : cut[i + 1]].view(np.int64))
                    marks.append(mark[cut[i] : cut[i + 1]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), _list(keys), _list(marks)], ["id", "n", "sha", "keys", "marks"])

    return docs.mapInArrow(work, "id long, n long, sha string, keys array<long>, marks array<long>")


def _contexts(texts: DataFrame, length: int, seed: int) -> DataFrame:
    """Per shared anchor, what its strings have behind the seed and, backwards, before it."""
    texts = texts.select("rid", "text", F.transform("shared", lambda x: F.struct(x.key, x.mark)).alias("shared"))

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part, out = batch.slice(at, 64), [[] for _ in range(5)]
                for row, text, shared in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    data = text.encode()
                    for key, mark in (x.values() for x in shared):
                        place, a, b = mark >> 32, mark >> 16 & 0xFFFF, mark & 0xFFFF
                        head = data[place - a : place]
                        for column, x in zip(out, (key, data[place + seed : place - b + length], head[::-1], row, place), strict=True):
                            column.append(x)
                kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["key", "behind", "before", "rid", "place"])

    return texts.mapInArrow(work, "key long, behind binary, before binary, rid long, place long")


def intervals(lcp: list[int] | np.ndarray, n: int) -> Iterator[tuple[int, int, int]]:
    """The (common prefix, first, last) intervals of n sorted strings; lcp[i]: of strings i and i + 1.

    One scan with a stack; every interval is given after those inside it.
    """
    stack: list[tuple[int, int]] = []
    for i in range(1, n + 1):
        now, left = lcp[i - 1] if i < n else -1, i - 1
        while stack and stack[-1][0] > now:
            size, left = stack.pop()
            yield size, left, i - 1
        if now >= 0 and (not stack or stack[-1][0] < now):
            stack.append((now, left))


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    size = np.diff(offsets)
    at = offsets[:-1, None] + np.arange(width)
    held = np.arange(width) < size[:, None]
    return np.where(held, data[np.minimum(at, max(0, len(data) - 1))] if len(data) else 0, 0).astype(np.uint8), size


def _common(x: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Lengths of common prefixes, at most size."""
    differ = np.concatenate([x != y, np.ones((len(x), 1), bool)], 1)
    return np.minimum(differ.argmax(1), size)


def maximal_repeats(behind: np.ndarray, nb: np.ndarray, before: np.ndarray, na: np.ndarray, least: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(bytes before the seed, bytes behind it, members) of the maximal repeats of one seed's suffixes.

    Rows are sorted by `behind`. The stack scan of the suffix array gives its common-prefix intervals; the
    members of one agree that far to the right. Sorted by what stands before them, backwards, the same
    scan gives the groups that agree to the left; a group's common prefix ends where its members'
    preceding bytes differ, so it is left-diverse. It is a maximal repeat if it isn't inside one child
    interval, and is given if it has `least` bytes besides the seed.
    """
    right = _common(behind[1:], behind[:-1], np.minimum(nb[1:], nb[:-1]))
    by_left = np.lexsort([na, *before.T[::-1]])
    rank = np.empty(len(na), np.int64)
    rank[by_left] = np.arange(len(na))
    for size, i, j in intervals(right, len(nb)):
        members = i + np.argsort(rank[i : j + 1], kind="stable")
        left = _common(before[members[1:]], before[members[:-1]], np.minimum(na[members[1:]], na[members[:-1]]))
        for extent, a, b in intervals(left, len(members)):
            if extent + size >= least:
                group = members[a : b + 1]
                if right[group.min() : group.max()].min() == size:
                    yield extent, size, group


def _scanned(contexts: DataFrame, length: int, seed: int) -> DataFrame:
    """Occurrences (rid, first, last, repeat) of maximal repeats, from the sorted suffixes of each seed."""
    width = length - seed

    def scan(rows: pa.Table):
        key = rows["key"].to_numpy()
        rid, place = rows["rid"].to_numpy(), rows["place"].to_numpy()
        (behind, nb), (before, na) = (_matrix(rows[c].combine_chunks() if not isinstance(rows[c].combine_chunks(), pa.ChunkedArray) else rows[c].combine_chunks().chunk(0), width) for c in ("behind", "before"))
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        same = key[1:] == key[:-1]
        right = np.where(same, _common(behind[1:], behind[:-1], np.minimum(nb[1:], nb[:-1])), -1)
        left = np.where(same, _common(before[1:], before[:-1], np.minimum(na[1:], na[:-1])), -1)
        alike = (right == nb[1:]) & (right == nb[:-1]) & (left == na[1:]) & (left == na[:-1])
        out = [[], [], [], []]

        def emit(rows_, a, b, name):
            for column, x in zip(out, (rid[rows_], place[rows_] - a, place[rows_] + seed + b, name), strict=True):
                column.append(np.broadcast_to(x, len(rows_)))

        count = np.diff(edge)
        # Seeds of two suffixes have one interval; those of more but equal ones as well.
        two = edge[:-1][count == 2]
        two = two[right[two] + left[two] >= width]
        name = tn.mix64(key[two].view(np.uint64) ^ (left[two] * 512 + right[two]).astype(np.uint64)).view(np.int64)
        for k in (0, 1):
            emit(two + k, left[two], right[two], name)
        unequal = np.concatenate([[0], np.cumsum(~alike)])
        for a, b in zip(edge[:-1][count > 2], edge[1:][count > 2], strict=True):
            if unequal[b - 1] == unequal[a]:
                if na[a] + nb[a] >= width:
                    emit(np.arange(a, b), na[a], nb[a], key[a])
                continue
            for n, (extent, size, group) in enumerate(maximal_repeats(behind[a:b], nb[a:b], before[a:b], na[a:b], width)):
                emit(group + a, extent, size, int(tn.mix64(key[a : a + 1].view(np.uint64) ^ U64(n + 1)).view(np.int64)[0]))
        columns = [np.concatenate([np.zeros(0, np.int64), *x]) for x in out]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["rid", "first", "last", "repeat"])

    def work(batches):
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            key = held["key"].to_numpy()
            done = int(np.searchsorted(np.cumsum(np.concatenate([[False], key[1:] != key[:-1]])), np.count_nonzero(key[1:] != key[:-1]), "left")) if len(key) else 0
            if done >= 5_000:
                yield scan(held.slice(0, done).combine_chunks())
                held = held.slice(done)
        if held is not None and held.num_rows:
            yield scan(held.combine_chunks())

    ordered = contexts.select("key", "behind", "before", "rid", "place").repartition("key").sortWithinPartitions("key", "behind", "before")
    return ordered.mapInArrow(work, "rid long, first long, last long, repeat long")


def _strings(column_before: list[bytes], column_behind: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bytes before the seed, hash) of each string around the seeds of some contexts."""
    texts = [x[::-1] + y for x, y in zip(column_before, column_behind, strict=True)]
    size = np.array([len(x) for x in texts])
    count = np.maximum(size - width + 1, 0)
    row = np.repeat(np.arange(len(texts)), count)
    shift = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = np.repeat(np.cumsum(size) - size, count) + shift
    before = np.repeat([len(x) for x in column_before], count).astype(np.int64) - shift
    h = tn.span_hashes(tn.prefix_sums(np.frombuffer(b"".join(texts), np.uint8)), start, start + width)
    return row, before, tn.mix64(h + before.astype(np.uint64) * U64(0xD1342543DE82EF95)).view(np.int64)


def _counted(contexts: DataFrame, length: int, seed: int) -> DataFrame:
    """The same for seeds with very many suffixes, whose array no task should hold: maximal repeats by hashed strings.

    Suffixes with the same surroundings are one context, with their number. A context's strings around
    the seed meet those of others by hash; each string that stands twice gets the fingerprint of the set of
    contexts that hold it. Those of a context with one fingerprint are one repeat: the same members hold all
    its strings and what lies between them, and the next byte to either side has other members, so it is
    left-diverse and maximal. A longer repeat of fewer members whose every string has more members isn't found this way. Strings, contexts and rows are joined by key, the largest groups
    spread, so the work is in proportion to the contexts and no task gathers the suffixes of a seed.
    """
    width = length - seed

    def strings(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                row, before, h = _strings(part.column(2).to_pylist(), part.column(1).to_pylist(), width)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), pa.array(h), part.column(3).take(take), pa.array(before), part.column(4).take(take)], ["key", "h", "context", "offset", "n"])

    same = ["key", "c1", "c2"]
    plain = contexts.select("key", F.xxhash64("behind", "before").alias("c1"), F.xxhash64(F.lit(1), "before", "behind").alias("c2"), "behind", "before", "rid", "place")
    plain = materialize(plain, "often")
    alike = plain.groupBy(*same).agg(F.any_value("behind").alias("behind"), F.any_value("before").alias("before"), F.count("*").alias("n"))
    alike = materialize(alike.withColumn("context", F.monotonically_increasing_id()), "contexts")
    every = alike.select("key", "behind", "before", "context", "n").mapInArrow(strings, "key long, h long, context long, offset long, n long")
    members = [F.bit_xor(F.xxhash64(F.lit(i), "context")).alias(f"m{i}") for i in (2, 3)]
    often = every.groupBy("key", "h").agg(F.sum("n").alias("n"), F.count("*").alias("size"), *members).filter("n > 1")
    often = materialize(often.select("key", "h", "size", F.xxhash64("key", "m2", "m3").alias("repeat")), "strings")
    held = join_groups(every.select("key", "h", "context", "offset"), often, ["key", "h"], "size", "context", inner=True)
    runs = held.groupBy("context", "repeat").agg(F.max("offset").alias("far"), F.min("offset").alias("near"))
    runs = runs.groupBy("context").agg(F.collect_list(F.struct("repeat", "far", "near")).alias("runs"))
    runs = materialize(alike.select(*same, "n", "context").join(runs, "context").select(*same, "n", "runs"), "runs")
    rows = join_groups(plain.select(*same, "rid", "place"), runs, same, "n", "rid", hot=2_000, inner=True)
    rows = rows.select("rid", "place", F.explode("runs").alias("x"))
    return rows.select("rid", (F.col("place") - F.col("x.far")).alias("first"), (F.col("place") - F.col("x.near") + length).alias("last"), "x.repeat")


def _merged(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that spans cover together."""
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(last[order])
    new = np.flatnonzero(np.concatenate([[True], first[1:] > reach[:-1]]))
    return first[new], reach[np.concatenate([new[1:] - 1, [len(reach) - 1]])]


def _removed(spans: DataFrame) -> DataFrame:
    """rid, text, spans (first, last; not empty) to rid, spans (merged), kept_sha256."""

    def work(batches):
        kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        for batch in batches:
            merged, digests = [], []
            for text, own in zip(batch.column(1), batch.column(2), strict=True):
                first, last = _merged(*(own.values.field(i).to_numpy() for i in (0, 1)))
                data, at, kept = memoryview(text.as_buffer()), 0, hashlib.sha256()
                for a, b in zip(first.tolist(), last.tolist(), strict=True):
                    kept.update(data[at:a])
                    at = b
                kept.update(data[at:])
                merged.append([{"first": a, "last": b} for a, b in zip(first.tolist(), last.tolist(), strict=True)])
                digests.append(kept.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(merged, kind), pa.array(digests, pa.string())], ["rid", "spans", "kept_sha256"])

    return spans.mapInArrow(work, "rid long, spans array<struct<first: long, last: long>>, kept_sha256 string")


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, seed: int = 64, hot: int = 20_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, texts, repeats): a row per document (rid, id, n, sha, rep, copies), the texts with shared
    seeds (rid, text), and the occurrences of repeats in them (rid, first, last, repeat).

    Equal texts form a class, whose first member (rid = rep) alone is searched. Spans are in bytes of
    the UTF-8 text; strings of `length` bytes that start twice lie in repeats, and all occurrences of a
    repeat carry its number. The maximal repeats around a seed come from the scan of its suffix array; an
    array of more than `hot` suffixes is too much for a task, and its repeats come from hashed strings
    (see _counted()). Together they cover the same bytes and each given repeat is maximal, but a maximal repeat all of whose
    strings of `length` bytes stand in further contexts as well gets no number of its own there.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sampled = materialize(_sampled(docs, length, seed).withColumn("rid", F.monotonically_increasing_id()), "sampled")
    classes = materialize(sampled.groupBy("sha", "n").agg(F.min("rid").alias("rep"), F.count("*").alias("copies")), "classes")
    first = sampled.filter(F.col("n") >= length).join(classes.select(F.col("rep").alias("rid")), "rid", "left_semi")
    every = first.select("rid", "id", "sha", F.explode(F.arrays_zip("keys", "marks")).alias("x")).select("rid", F.col("x.keys").alias("key"), F.col("x.marks").alias("mark"))
    shared = materialize(every.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key", (F.col("c") > hot).alias("hot")), "shared")
    marked = every.join(shared, "key").groupBy("rid").agg(F.collect_list(F.struct("key", "hot", "mark")).alias("shared"))
    marked = marked.join(sampled.select("rid", "id", "sha"), "rid")
    wanted = marked.select("rid", "shared", F.col("id").alias("_id"), F.col("sha").alias("_sha"))
    match = F.col("id").eqNullSafe(F.col("_id")) & (F.sha2("text", 256) == F.col("_sha"))
    texts = materialize(docs.join(wanted, match).select("rid", "text", "shared").dropDuplicates(["rid"]), "texts")
    of = lambda kind: _contexts(texts.withColumn("shared", F.filter("shared", lambda x: x.hot if kind else ~x.hot)).filter(F.size("shared") > 0), length, seed)
    repeats = _scanned(of(False), length, seed).unionByName(_counted(of(True), length, seed))
    rows = join_groups(sampled.select("rid", "id", "n", "sha"), classes.filter("copies > 1"), ["sha", "n"], "copies", "rid")
    rows = rows.withColumns({"rep": F.coalesce("rep", "rid"), "copies": F.coalesce("copies", F.lit(1).cast("long"))})
    return rows, texts.select("rid", "text"), repeats


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, **options) -> DataFrame:
    """One row per input row: id_col, n_bytes, n_removed, n_spans, kept_sha256, spans.

    Removed is each byte covered by a string of `length` bytes that starts anywhere else as well, in
    another document or the same; all strings are judged on the input. Documents with equal texts of
    `length` bytes or more are removed whole. Null texts are empty; shorter texts lose nothing; null and
    repeated ids are documents of their own. Very long texts (up to 2 GB) are searched whole, in slices.
    Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    rows, texts, repeats = find_repeats(docs, id_col, text_col, length, **options)
    spans = materialize(repeats.groupBy("rid").agg(F.collect_set(F.struct("first", "last")).alias("spans")), "spans")
    cut = _removed(texts.join(spans, "rid").select("rid", "text", "spans"))
    out = rows.join(cut, "rid", "left")
    whole = (F.col("copies") > 1) & (F.col("n") >= length)
    n_removed = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x.last - x.first), F.lit(0).cast("long"))
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_bytes"),
        F.when(whole, F.col("n")).otherwise(n_removed).alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce(F.size("spans"), F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(whole, F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("n").alias("last")))).otherwise(F.coalesce("spans", F.array().cast("array<struct<first: long, last: long>>"))).alias("spans"),
    )


ORACLE_SQL = r"""
WITH h AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), starts AS (
  SELECT doc_id, i, md5(substr(x, 2 * i + 1, 400)) AS m FROM (SELECT doc_id, x, unnest(range(len(x) // 2 - 199)) AS i FROM h)
), twice AS (
  SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM starts WHERE m IN (SELECT m FROM starts GROUP BY m HAVING count(*) > 1)
), runs AS (
  SELECT doc_id, min(i) AS a, max(i) + 200 AS b
  FROM (SELECT doc_id, i, sum(CASE WHEN gap <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM twice) GROUP BY doc_id, run
), kept AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM runs
), cut AS (
  SELECT k.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(x, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS rest
  FROM kept k JOIN h USING (doc_id) GROUP BY k.doc_id
)
SELECT h.doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(from_hex(coalesce(rest, x))) AS kept_sha256
FROM h LEFT JOIN cut USING (doc_id)
"""
