"""MinHash near-dedup: fast similarity sketches, banding, exact verification, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from minewright.llm import textnum as tn
from minewright.llm.common import Scratch, fresh, join_groups, with_row_identity
from minewright.llm.decontaminate import passing, stored_filter, write_filter
from minewright.llm.graph import connected_components

U64 = np.uint64


def fast_sketch(x: np.ndarray, t: int, at_once: int = 2000) -> np.ndarray:
    """The t coordinates of a set of distinct 64-bit hashes (not empty; t at most 256).

    In round i < t each element falls into a hashed bin with a hashed value; in round t + j all fall
    into bin j, so every bin fills. A bin keeps the least value of the first round that reaches it.
    Two sets agree in a coordinate with the probability of their Jaccard similarity, and the share of
    agreeing coordinates is concentrated as for independent ones, at O(n + t log t) hashes.
    Rounds are taken several at once; those past the last that fills a bin change nothing.
    """
    out = np.zeros(t, np.uint64)
    empty = np.ones(t, bool)
    bins = np.arange(t, dtype=np.uint64) << U64(56)
    low = U64((1 << 46) - 1)
    i = 0
    while i < 2 * t and empty.any():
        r = min(max(1, -(-at_once // len(x))), (t if i < t else 2 * t) - i)
        rounds = np.arange(i, i + r, dtype=np.uint64)[:, None]
        h = tn.mix64(x[None, :] + (rounds + U64(1)) * U64(0xD1342543DE82EF95))
        place = (h >> U64(40)) * U64(t) >> U64(24) if i < t else np.broadcast_to(rounds - U64(t), h.shape)
        s = np.sort((place << U64(56) | rounds << U64(46) | h & low).ravel())
        at = np.searchsorted(s, bins)
        got = at < len(s)
        got[got] = s[at[got]] >> U64(56) == bins[got] >> U64(56)
        new = got & empty
        out[new] = s[at[new]] & U64((1 << 56) - 1)
        empty &= ~got
        i += r
    return out


def shingle_sets(column: pa.ChunkedArray | pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text in turn, the sorted hashes of its distinct k-word shingles.

    A-Z count as a-z; a text of fewer words has one shingle, all of them; one without words has none.
    """
    for chunk in tn.chunks(column):
        w = tn.words(chunk)
        h = tn.span_hashes(tn.prefix_sums(chunk.data, lower=True), w.start, w.end)
        grams, first = tn.ngram_hashes(h, w.first, k)
        for i in range(len(chunk)):
            if first[i] < first[i + 1]:
                yield np.unique(grams[first[i] : first[i + 1]])
            else:
                whole = np.zeros(1, np.uint64)
                for x in h[w.first[i] : w.first[i + 1]]:
                    whole = tn.mix64(whole * U64(0xA0761D6478BD642F) + x + U64(1))
                yield whole[: int(w.first[i] < w.first[i + 1])]


def _sketches(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    if bands * rows > 256:
        raise ValueError(f"{bands} bands of {rows} need {bands * rows} coordinates, a sketch has at most 256")

    def work(batches):
        for batch in batches:
            prints, keys, ends = [], [], [0]
            for x in shingle_sets(batch.column(1), k):
                prints.append(_fingerprint(x))
                if len(x):
                    s = fast_sketch(x, bands * rows).reshape(bands, rows)
                    key = np.arange(bands, dtype=np.uint64)
                    for j in range(rows):
                        key = tn.mix64(key * U64(0xA0761D6478BD642F) + s[:, j])
                    keys.append(key)
                ends.append(len(keys) * bands)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))
            columns = zip(*prints, strict=True) if prints else [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *[pa.array(c, pa.int64()) for c in columns], lists], ["id", "place", "n", "ha", "hb", "keys"])

    docs = docs.select("id", "text", "place")
    return docs.mapInArrow(work, T.StructType([docs.schema["id"], docs.schema["place"], *[T.StructField(c, T.LongType()) for c in ("n", "ha", "hb")], T.StructField("keys", T.ArrayType(T.LongType()))]))


def _shared_keys(classes: DataFrame, folder: str) -> DataFrame:
    """key, id, n of the classes' keys that the filter of shared keys in the folder lets through: all that are shared, few others.

    Most keys belong to one class alone, so a join of keys needs to shuffle only these.
    """

    def work(batches):
        bits = stored_filter(folder)
        for batch in batches:
            keys = _arrays(batch.column(2))
            hit = passing(bits, np.concatenate([np.zeros(0, np.uint64), *keys]))
            row = pa.array(np.repeat(np.arange(len(keys)), [len(x) for x in keys])[hit])
            flat = np.concatenate([np.zeros(0, np.uint64), *keys])[hit].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat), batch.column(0).take(row), batch.column(1).take(row)], ["key", "id", "n"])

    return classes.select("id", "n", "keys").mapInArrow(work, "key long, id long, n long")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """id and text to id and shingles, the hashes of the text's set."""

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(list(shingle_sets(part.column(1), k)))], ["id", "shingles"])

    return docs.mapInArrow(work, "id long, shingles array<long>")


def _class_sets(docs: DataFrame, wanted: str, k: int) -> DataFrame:
    """id and shingles of the wanted rows: docs (text, place) to the sets of those that the table of ids by place names.

    The table lies in a folder per input file, so a task that reads a file's texts looks its wanted rows up there.
    Neither texts nor ids are shuffled, however many are wanted.
    """

    def work(batches):
        held, rows, ids = None, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            file, row = (batch.column(1).field(i).to_numpy() for i in (0, 1))
            edges = np.flatnonzero(np.concatenate([[True], file[1:] != file[:-1]])) if len(file) else []
            for a, b in zip(edges, [*edges[1:], len(file)], strict=True):
                if file[a] != held:
                    held, (rows, ids) = file[a], _wanted_rows(wanted, int(file[a]))
                at = np.minimum(np.searchsorted(rows, row[a:b]), max(0, len(rows) - 1))
                hit = np.flatnonzero(rows[at] == row[a:b]) if len(rows) else np.zeros(0, np.int64)
                for i in range(0, len(hit), 500):
                    some = hit[i : i + 500]
                    sets = list(shingle_sets(batch.column(0).take(pa.array(a + some)), k))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at[some]]), _lists(sets)], ["id", "shingles"])

    return docs.select("text", "place").mapInArrow(work, "id long, shingles array<long>")


def _wanted_rows(folder: str, file: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers, sorted, and ids that are wanted from a file."""
    store, base = fs.FileSystem.from_uri(folder)
    found = store.get_file_info(fs.FileSelector(f"{base}/file={file}", allow_not_found=True))
    parts = [pq.read_table(x.path, filesystem=store, columns=["row", "id"], partitioning=None) for x in found if x.base_name.endswith(".parquet")]
    rows, ids = (np.concatenate([np.zeros(0, np.int64), *[p[c].to_numpy() for p in parts]]) for c in ("row", "id"))
    order = np.argsort(rows)
    return rows[order], ids[order]


def _fingerprint(x: np.ndarray) -> tuple[int, int, int]:
    """Size and two hashes of a set; sets that agree in all three count as equal."""
    a = np.bitwise_xor.reduce(tn.mix64(x ^ U64(0x5851F42D4C957F2D))) if len(x) else U64(0)
    return len(x), int(a.astype(np.int64)), int(x.sum(dtype=np.uint64).astype(np.int64))


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.uint64), *values]).view(np.int64)))


def _arrays(column: pa.ListArray) -> list[np.ndarray]:
    values, ends = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
    return [values[a - ends[0] : b - ends[0]] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _star_links(pairs: DataFrame, sets: DataFrame, percent: int, per_task: int = 256) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have a Jaccard similarity of percent / 100 at least.

    A leader in very many pairs is copied once per `per_task` of them, so its pairs are spread. Sets get other names
    only behind their exchange, so leaders and members read the same one.
    """
    copies = pairs.groupBy("a").agg(F.ceil(F.count("*") / per_task).cast("int").alias("copies"))
    pairs = pairs.join(copies, "a").select("a", "b", F.pmod(F.hash("b"), "copies").alias("copy"))
    sets = sets.select("id", "shingles")
    right = pairs.join(sets, F.col("b") == F.col("id")).select("a", "b", "copy", F.col("shingles").alias("sb"))
    left = sets.join(copies, F.col("a") == F.col("id")).select("a", F.col("shingles").alias("sa"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    both = F.size(F.array_intersect("sa", "sb"))
    joined = right.join(left, ["a", "copy"]).select("a", "b", both.cast("long").alias("both"), (F.size("sa") + F.size("sb")).cast("long").alias("sum"))
    return joined.filter(F.col("both") * 100 >= (F.col("sum") - F.col("both")) * percent).select("a", "b")


def block_links(components: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Linked pairs of components, found from all pairs of some documents; enough to join those that links join.

    Intersection sizes come from a 0/1 matrix over the shingles that two documents share, a slice of
    them at a time.
    """
    token, count = np.unique(np.concatenate(sets), return_counts=True)
    token = token[count > 1]
    n = np.array([len(x) for x in sets])
    both = np.zeros((len(sets), len(sets)), np.float32)
    step = max(1, (8 << 20) // len(sets))
    for at in range(0, len(token), step):
        some = token[at : at + step]
        mark = np.zeros((len(sets), len(some)), np.float32)
        for i, x in enumerate(sets):
            where = np.searchsorted(some, x)
            where = where[(where < len(some)) & (some[np.minimum(where, len(some) - 1)] == x)]
            mark[i, where] = 1
        both += mark @ mark.T
    comp = np.array(components)
    hit = (both * 100 >= (n[:, None] + n[None, :] - both) * percent) & (comp[:, None] != comp[None, :])
    root = {c: c for c in components}

    def top(c):
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    out = []
    for i, j in zip(*np.nonzero(np.triu(hit, 1)), strict=True):
        a, b = top(components[i]), top(components[j])
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((a, b))
    return out


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])


def _small_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Linked components within buckets that one task can hold: members (key, id, component) to (a, b)."""

    def work(batches):
        held: list[tuple] = []
        now = None
        for batch in batches:
            found = []
            for key, component, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _arrays(batch.column(2)), strict=True):
                if key != now:
                    found += closed(held)
                    held, now = [], key
                held.append((component, np.sort(own)))
            if found:
                yield _pairs(found)
        if found := closed(held):
            yield _pairs(found)

    def closed(held):
        return block_links(*(list(x) for x in zip(*held, strict=True)), percent) if len({x[0] for x in held}) > 1 else []

    joined = members.join(sets, "id").select("key", "component", "shingles").repartition("key").sortWithinPartitions("key")
    return joined.mapInArrow(work, "a long, b long").distinct()


def _counted(rows: DataFrame) -> DataFrame:
    """key, c, values (array) to key, c, value, m: in how many rows of the key a value stands; summed in batches first."""

    def work(batches):
        for batch in batches:
            own = _arrays(batch.column(2))
            size = np.array([len(x) for x in own], np.int64)
            value = np.concatenate([np.zeros(0, np.uint64), *own]).view(np.int64)
            key, c = (np.repeat(batch.column(i).to_numpy(), size) for i in (0, 1))
            order = np.lexsort((value, key))
            value, key, c = value[order], key[order], c[order]
            new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (value[1:] != value[:-1])])) if len(key) else np.zeros(0, np.int64)
            m = np.diff(np.append(new, len(key)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[new], c[new], value[new], m)], ["key", "c", "value", "m"])

    return rows.mapInArrow(work, "key long, c long, value long, m long").groupBy("key", "c", "value").agg(F.sum("m").alias("m"))


def _differences(rows: DataFrame, per_task: int) -> DataFrame:
    """rows (key, c, id, component, shingles) to key, c, id, component, n, d: what tells each set from its bucket's centre.

    The centre of a bucket is the set of shingles that more than half of its members hold (at most
    twice as many as they have on average); it is copied once per `per_task` members.
    """
    centres = _counted(rows.select("key", "c", "shingles")).filter("m * 2 > c").groupBy("key", "c").agg(F.collect_list("value").alias("centre"))
    copies = F.ceil(F.col("c") / per_task).cast("int")
    centres = centres.select("key", "centre", F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"))
    rows = rows.withColumn("copy", F.pmod(F.hash("id"), copies)).join(centres, ["key", "copy"], "left").select("key", "c", "id", "component", "shingles", F.coalesce("centre", F.array().cast("array<long>")).alias("centre"))

    def work(batches):
        for batch in batches:
            sets, centres = _arrays(batch.column(4)), _arrays(batch.column(5))
            d = [np.setxor1d(x, y, assume_unique=True) for x, y in zip(sets, centres, strict=True)]
            n = pa.array([len(x) for x in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], n, _lists(d)], ["key", "c", "id", "component", "n", "d"])

    return rows.mapInArrow(work, "key long, c long, id long, component long, n long, d array<long>")


def _centre_links(rows: DataFrame, percent: int, per_task: int, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """(linked components, what is left) of buckets of any size; rows: key, c, id, component, shingles.

    With D the difference of a set A from its bucket's centre, |A ^ B| = |D(A) ^ D(B)| on the full sets. A and
    B are linked if 100 + percent times that is at most 100 - percent times |A| + |B|, so with
    slack(A) = (100 + percent) |D(A)| - (100 - percent) |A| they are linked if slack(A) + slack(B) isn't
    above 0, whatever D(A) and D(B) share. Every member is held against the one of least slack: one
    comparison of two numbers links all that lie around a common text.

    The other members can only be linked with sets that share elements of their difference, at
    least half of the slacks' sum over 100 + percent. So each is looked for among the members that hold one of
    the first elements of its D, those that fewest members have: all but the last needed - 1. What is left are
    the members with such an element as buckets (key, id, component) of their own. An element of D stands in the
    difference of at most half of the bucket's members, so these buckets are half as large at most.
    """
    d = scratch.keep(_differences(rows, per_task), "differences")
    slack = (100 + percent) * F.size("d") - (100 - percent) * F.col("n")
    near = d.select("key", "c", "id", "component", slack.alias("s"))
    low = near.groupBy("key").agg(F.min(F.struct("s", "component")).alias("low"), F.count("*").alias("size"))
    near = join_groups(near, low.select("key", "size", F.col("low.s").alias("ls"), F.col("low.component").alias("lc")), ["key"], "size", "id", inner=True)
    auto = near.filter("s + ls <= 0 AND component <> lc").select(F.col("component").alias("a"), F.col("lc").alias("b")).distinct()
    unit = 2 * (100 + percent)
    far = near.filter("s + ls > 0").select("key", "id", F.expr(f"cast((s + ls + {unit - 1}) div {unit} as int)").alias("needed"))
    far = scratch.keep(far, "far")
    if far.isEmpty():
        return auto, None
    often = scratch.keep(_counted(d.select("key", "c", "d")).filter("m > 1").select("key", "value", "m"), "often")
    mine = far.join(d.select("key", "id", "d"), ["key", "id"]).select("key", "id", "needed", F.explode("d").alias("value"))
    mine = join_groups(mine, often, ["key", "value"], "m", "id", inner=True)
    first = mine.groupBy("key", "id", "needed").agg(F.sort_array(F.collect_list(F.struct("m", "value"))).alias("x"))
    first = first.select("key", F.explode(F.slice("x", F.lit(1), F.greatest(F.lit(0), F.size("x") - F.col("needed") + 1))).alias("x"))
    wanted = scratch.keep(first.select("key", "x.value", "x.m").distinct(), "wanted")
    held = join_groups(d.select("key", "id", "component", F.explode("d").alias("value")), wanted, ["key", "value"], "m", "id", inner=True)
    return auto, held.select(F.xxhash64("key", "value").alias("key"), "id", "component")


def _spanning(members: DataFrame, scratch: Scratch) -> DataFrame:
    """members (key, id, component) of buckets in which components meet, with their size c; of buckets with the same members, one."""
    h = F.xxhash64("id")
    mixed = members.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("c"), F.bit_xor(h).alias("h"), F.sum(F.xxhash64(F.lit(1), "id").cast("decimal(38,0)")).alias("g"))
    mixed = scratch.keep(mixed.filter("x < y").groupBy("c", "h", "g").agg(F.min("key").alias("key")).select("key", "c"), "mixed")
    return join_groups(members, mixed, ["key"], "c", "id", inner=True).select("key", "c", "id", "component")


def _relabelled(members: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """members with the component that links between components make of theirs."""
    found = connected_components(links, scratch=scratch).withColumnRenamed("component", "_now")
    return members.join(found.withColumnRenamed("id", "component"), "component", "left").withColumn("component", F.coalesce("_now", "component")).drop("_now")


def _bucket_links(members: DataFrame, sets: DataFrame, percent: int, block: int = 512, scratch: Scratch | None = None) -> DataFrame:
    """Links (a, b) between the components of members (key, c, id, component), enough to join all that links within buckets join.

    Buckets of at most `block` members are compared pair by pair, each within a task, of which only
    links come out. Larger ones are resolved around their centres (see _centre_links()), which makes
    rows in proportion to the members, and what is left of them are buckets of at most half the size, down
    to those that fit into a block. So no bucket is gathered in one task and no pair is left out.
    """
    scratch = scratch or Scratch(members.sparkSession, "buckets")
    links = None
    while True:
        found = _small_links(members.filter(F.col("c") <= block), sets, percent)
        large = members.filter(F.col("c") > block)
        if large.isEmpty():
            return found if links is None else links.unionByName(found)
        auto, rest = _centre_links(scratch.keep(large.join(sets, "id").select("key", "c", "id", "component", "shingles"), "large"), percent, block, scratch)
        found = scratch.keep(found.unionByName(auto), "found")
        scratch.release()
        links = found if links is None else links.unionByName(found)
        if rest is None:
            return links
        members = scratch.keep(_spanning(scratch.keep(_relabelled(rest, links, scratch), "rest"), scratch), "members")


def _merged(members: DataFrame, scratch: Scratch) -> DataFrame:
    """members (key, id, component) with the buckets that share members made one: key, c, id, component, each id once."""
    first = members.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("c"))
    edges = join_groups(members.select("key", "id"), first, ["key"], "c", "id", inner=True).select(F.col("first").alias("a"), F.col("id").alias("b"))
    whole = connected_components(edges, scratch=scratch).withColumnRenamed("component", "key")
    rows = members.select("id", "component").distinct().join(whole, "id")
    return scratch.keep(_spanning(scratch.keep(rows, "rest"), scratch), "merged")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, bands: int = 40, rows: int = 5, block: int = 512, merge: int = 32) -> DataFrame:
    """One row per input row: id_col, n_shingles, component_id, kept.

    Two documents are linked if the Jaccard similarity of their sets of k-word shingles is percent / 100
    at least; a component is what links reach, and its smallest id is kept. Rows with equal sets are
    one class and only one of them goes on. Classes that share one of `bands` keys of `rows` sketch
    coordinates are candidates (at 40 x 5 and similarity 0.8, 1.3e-7 of linked pairs share none).
    Candidates are verified on their full sets. First each class is compared with the first one of its
    bucket only, which joins most groups of copies at one comparison per copy and leader. Then buckets whose
    other classes still are in several components are gone through. As a large group of near copies meets in
    many bands, those of more than `merge` classes that share classes are made one, so each class is looked at
    once, and resolved: up to `block` classes pair by pair, more around their centre (see _bucket_links()). The
    others are compared pair by pair; buckets with the same members are taken once. So no pair of a bucket is
    left out unless its two classes are already joined, and no step's rows grow with the square of a bucket.

    Null, empty and blank texts have an empty set and are linked with nothing. Rows that repeat an id are in
    one component, also if their texts differ. A null id is its own component (null) and kept. Ids may be of any
    type that has an order; of equal ones, ties can't matter. Other columns
    are ignored, whatever their names. Very long texts: a set must fit into a row, and the sets of a block
    into a task. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "near")
    place = fresh(docs, "_place")
    docs = with_row_identity(docs, place).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(place).alias("place"))
    sketches = scratch.keep(_sketches(docs, k, bands, rows), "sketches")
    known = sketches.filter("n > 0 AND id IS NOT NULL")
    same = ["n", "ha", "hb"]
    classes = known.groupBy(*same).agg(F.min("id").alias("first"), F.count("*").alias("size"), F.any_value("keys").alias("keys"), F.any_value("place").alias("place"))
    classes = scratch.keep(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    # Keys take most of these tables, so they go when the buckets are made.
    sketches = scratch.keep(sketches.select("id", *same), "prints")
    known = sketches.filter("n > 0 AND id IS NOT NULL")
    scratch.drop("sketches")
    buckets = classes.select(F.explode("keys").alias("key"), "id", "n")
    led = scratch.keep(buckets.groupBy("key").agg(F.min(F.struct("id", "n")).alias("lead"), F.count("*").alias("c")).filter("c > 1"), "leaders")
    write_filter(led, "key", f"{scratch.folder}/filter-0")
    shared = scratch.keep(_shared_keys(classes, f"{scratch.folder}/filter-0"), "shared")
    members = join_groups(shared, led, ["key"], "c", "id", inner=True).filter(F.col("lead.id") != F.col("id")).select("key", "id", "n", "lead")
    members = scratch.keep(members, "members")
    scratch.release()
    wanted = members.select("id").unionByName(members.select("lead.id")).distinct().join(classes.select("id", "place.file", "place.row"), "id")
    folder = f"{scratch.folder}/places-0"
    wanted.repartition("file").write.partitionBy("file").parquet(folder)
    classes = scratch.keep(classes.drop("keys", "place"), "named_classes")
    scratch.drop("classes", "leaders", "shared", "filter")
    sets = _class_sets(docs, folder, k)
    repeated = scratch.keep(known.groupBy("id").agg(F.count("*").alias("size")).filter("size > 1"), "repeated")
    sets = scratch.keep(sets, "sets")
    fits = F.least("lead.n", "n") * 100 >= F.greatest("lead.n", "n") * percent
    stars = scratch.keep(members.filter(fits).select(F.col("lead.id").alias("a"), F.col("id").alias("b")).distinct(), "stars")
    links = _star_links(stars, sets, percent)
    if not repeated.isEmpty():
        twice = join_groups(known.select("id", *same), repeated, ["id"], "size", "n", inner=True).drop("size")
        twice = twice.distinct().join(classes.select(*same, F.col("id").alias("b")), same).select("id", "b")
        twice = twice.join(twice.groupBy("id").agg(F.min("b").alias("a")), "id").filter("a < b").select("a", "b")
        links = links.unionByName(twice).distinct()
    links = scratch.keep(links, "links")
    scratch.release()
    found = connected_components(links, scratch=scratch)
    # Components only grow, so a bucket that lies in one needs no further look.
    spanning = lambda rows: scratch.keep(_spanning(rows.join(found, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component")), scratch), "spanning")
    rest = spanning(members.select("key", "id"))
    if not rest.filter(F.col("c") > merge).isEmpty():
        late = _bucket_links(_merged(rest.filter(F.col("c") > merge), scratch), sets, percent, block, scratch)
        links = links.unionByName(scratch.keep(late, "late"))
        found = connected_components(links, scratch=scratch)
        rest = spanning(rest.filter(F.col("c") <= merge).select("key", "id"))
    late = scratch.keep(_small_links(rest, sets, percent), "late")
    scratch.release()
    if not late.isEmpty():
        found = connected_components(links.unionByName(late), scratch=scratch)
    named = classes.join(found, "id", "left").select(*same, F.coalesce("component", "id").alias("component"), "first", "size")
    named = scratch.keep(named, "named")
    scratch.release()
    least = named.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("classes"))
    named = join_groups(named, least, ["component"], "classes", "first", inner=True).select(*same, "component_id", "size")
    joined = join_groups(sketches.select("id", *same), named, same, "size", "id")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    result = joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
    return scratch.done(result)


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) < 2 THEN ws ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh FROM w
), u AS (
  SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s
), links AS (
  SELECT a.doc_id AS i, b.doc_id AS j FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80
  GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))
), both_ways AS (
  SELECT i, j FROM links UNION ALL SELECT j, i FROM links
), reached AS (
  SELECT doc_id AS i, doc_id AS r FROM s UNION SELECT e.j, t.r FROM reached t JOIN both_ways e ON e.i = t.i
), component AS (
  SELECT i, min(r) AS c FROM reached GROUP BY 1
)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, c AS component_id, s.doc_id = c AS kept FROM s JOIN component ON component.i = s.doc_id
"""
