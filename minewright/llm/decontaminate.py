"""Benchmark decontamination: n-gram seeds join passages to test items, rare ones first, then Smith-Waterman alignment."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minewright.llm import textnum as tn
from minewright.llm.common import Scratch, fresh, join_groups, with_row_identity

MATCH, MISMATCH, GAP = 2, -1, -1
#: Items of a block, the bits of the filter of seeds (2^27: 16 MB), hits of a seed that one task joins, rows of a file that are looked up together.
BLOCK, FILTER_BITS, EACH, TOGETHER = 2_500, 27, 100_000, 1 << 20


class Items:
    """Some test items: their numbers in ascending order, own ids and words as hashes."""

    def __init__(self, number: np.ndarray, ids: list[int | None], words: list[np.ndarray]):
        self.at, self.ids, self.words = number, ids, words
        self.length = np.array([len(w) for w in words], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.length)])
        self.vocabulary, self.number = np.unique(np.concatenate([np.zeros(0, np.uint64), *words]), return_inverse=True)


def tokens(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per chunk: hashes of the lower-cased words (letters and digits), and each text's first word."""
    for chunk in tn.chunks(column, lower=True):
        w = tn.words(chunk, tn.ALNUM)
        yield tn.span_hashes(tn.prefix_sums(chunk.data), w.start, w.end), w.first


def _tokenised(benchmark: DataFrame) -> DataFrame:
    """id and text to id and words."""

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                part = batch.slice(at, 1_000)
                own = [hashes[x:y] for hashes, first in tokens(part.column(1)) for x, y in zip(first[:-1], first[1:], strict=True)]
                ends = np.concatenate([[0], np.cumsum([len(w) for w in own])]).astype(np.int32)
                words = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *own]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), words], ["id", "words"])

    return benchmark.mapInArrow(work, "id long, words array<long>")


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Words of all rows, and each row's first word."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy()[offsets[0] : offsets[-1]].view(np.uint64), (offsets - offsets[0]).astype(np.int64)


def _seeds(items: DataFrame, n: int) -> DataFrame:
    """item and words to the items' seeds: all n-word runs with their places; a shorter item is one seed."""

    def work(batches):
        for batch in batches:
            item = batch.column(0).to_numpy()
            words, first = _lists(batch.column(1))
            length = np.diff(first)
            seeds, starts = tn.ngram_hashes(words, first, n)
            row = np.repeat(np.arange(len(item)), np.diff(starts))
            found = [(seeds, row, np.arange(len(row)) - starts[row], np.full(len(row), n))]
            for size in range(1, n):
                short = np.flatnonzero(length == size)
                own = words[(first[short][:, None] + np.arange(size)).ravel()]
                seeds = tn.ngram_hashes(own, np.arange(len(short) + 1) * size, size)[0]
                found.append((seeds, short, np.zeros(len(short), np.int64), np.full(len(short), size)))
            seed, row, place, size = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), pa.array(item[row]), pa.array(place.astype(np.int64)), pa.array(size.astype(np.int64))], ["seed", "item", "place", "size"])

    return items.mapInArrow(work, "seed long, item long, place long, size long")


def _stored(folder: str, columns: list[str]) -> pa.Table | None:
    """The rows of a folder of Parquet files, in a task; None if there are none."""
    store, base = fs.FileSystem.from_uri(folder)
    found = store.get_file_info(fs.FileSelector(base, allow_not_found=True))
    parts = [pq.read_table(x.path, filesystem=store, columns=columns, partitioning=None) for x in found if x.base_name.endswith(".parquet")]
    return pa.concat_tables(parts).combine_chunks() if parts else None


@lru_cache(maxsize=2)
def stored_filter(folder: str) -> np.ndarray:
    """The bits that write_filter() has written, read once per Python process."""
    bits = np.zeros(1 << FILTER_BITS >> 3, np.uint8)
    rows = _stored(folder, ["part", "bits"])
    for part, own in zip(rows["part"].to_pylist(), rows["bits"].to_pylist(), strict=True) if rows else ():
        bits[part * len(own) : (part + 1) * len(own)] = np.frombuffer(own, np.uint8)
    return bits


def passing(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of the hashes that the filter lets through."""
    bit = (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
    return np.flatnonzero(bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)


def write_filter(rows: DataFrame, column: str, folder: str) -> None:
    """A filter of 2^FILTER_BITS bits that lets all hashes of the column through, and of others about as many as it has bits set."""
    bit = F.shiftrightunsigned(column, 64 - FILTER_BITS)
    pages = rows.groupBy(F.shiftright(bit, 15).alias("part")).agg(F.bitmap_construct_agg(F.pmod(bit, F.lit(1 << 15))).alias("bits"))
    pages.coalesce(1).write.parquet(folder)


def _hits(docs: DataFrame, folder: str, sizes: list[int]) -> DataFrame:
    """file, row, seed, word: the runs of the documents (text, place) that the filter lets through."""

    def work(batches):
        bits = stored_filter(folder)
        for batch in batches:
            file, row = (batch.column(1).field(i).to_numpy() for i in (0, 1))
            base = 0
            for hashes, first in tokens(batch.column(0)):
                for n in sizes:
                    grams, starts = tn.ngram_hashes(hashes, first, n)
                    hit = passing(bits, grams)
                    text = np.searchsorted(starts, hit, "right") - 1
                    yield pa.RecordBatch.from_arrays([pa.array(file[base + text]), pa.array(row[base + text]), pa.array(grams[hit].view(np.int64)), pa.array(hit - starts[text])], ["file", "row", "seed", "word"])
                base += len(first) - 1

    return docs.select("text", "place").mapInArrow(work, "file long, row long, seed long, word long")


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman: best local score and the span of text words that it covers.

    Row by row with numpy; a row's gaps in the text are a running maximum. Starts are carried along.
    """
    n = len(text)
    place = np.arange(n + 1)
    ramp, score, start = place * -GAP, np.zeros(n + 1, np.int64), place
    best = (0, 0, 0)
    for x in item:
        diagonal = score[:-1] + np.where(text == x, MATCH, MISMATCH)
        up = score[1:] + GAP
        now = np.concatenate([[0], np.maximum(np.maximum(diagonal, up), 0)])
        begin = np.concatenate([[0], np.where(now[1:] == 0, place[1:], np.where(diagonal >= up, start[:-1], start[1:]))])
        run = now + ramp
        lead = np.maximum.accumulate(run)
        source = np.maximum.accumulate(np.where(run == lead, place, 0))
        start, score = begin[source], lead - ramp
        j = int(score.argmax())
        if score[j] > best[0]:
            best = (int(score[j]), int(start[j]), j)
    return best


def ceilings(items: Items, hashes: np.ndarray, item: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each item and words a..b of a text: a score that align() can't exceed there.

    An item's word gains MATCH if it stands anywhere in the region, and costs at least a mismatch or a
    gap if not; an alignment covers a run of the item's words, so the best run of these sums is a bound.
    """
    n, size = len(hashes) + 1, items.length[item]
    near = np.flatnonzero(np.cumsum(np.bincount(a, minlength=n) - np.bincount(b, minlength=n)) > 0)  # words of any region
    at = np.minimum(np.searchsorted(items.vocabulary, hashes[near]), len(items.vocabulary) - 1)
    known = items.vocabulary[at] == hashes[near]
    stands = np.append(np.sort(at[known] * n + near[known]), np.iinfo(np.int64).max)  # by word, then by place
    begin = np.cumsum(size) - size
    row = np.repeat(np.arange(len(item)), size)
    word = items.number[np.arange(len(row)) + (items.first[item] - begin)[row]] * n
    there = stands[np.searchsorted(stands, word + a[row])] < word + b[row]
    gain = np.where(there, MATCH, max(MISMATCH, GAP))
    run = np.cumsum(gain) - row * (2 * MATCH * len(row) + 1)  # a row's sums lie below those of the rows before
    return np.maximum.reduceat(run - np.minimum.accumulate(run - gain), begin)


def regions(text: np.ndarray, item: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, item, first, last implied start) of the regions that hits open; hits are sorted by text and item, then rare ones first.

    A hit opens a region unless it implies a start within an item's length of one that a rarer hit has opened; such hits
    join the nearest region and widen it.
    """
    edge = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (item[1:] != item[:-1]), [True]])) if len(text) else np.zeros(1, np.int64)
    lone = edge[:-1][np.diff(edge) == 1]
    at, low, high = lone.tolist(), [begin[lone]], [begin[lone]]
    more = np.flatnonzero(np.diff(edge) > 1)
    for a, b in zip(edge[more].tolist(), edge[more + 1].tolist(), strict=True):
        own, reach, opened = begin[a:b], int(length[item[a]]), []
        for x in own.tolist():
            i = bisect_left(opened, x)
            if all(abs(x - y) > reach for y in opened[max(0, i - 1) : i + 1]):
                opened.insert(i, x)
        least, most = np.array(opened), np.array(opened)
        home = np.searchsorted((least[1:] + least[:-1]) / 2, own)
        np.minimum.at(least, home, own)
        np.maximum.at(most, home, own)
        at += [a] * len(opened)
        low.append(least)
        high.append(most)
    at = np.array(at, np.int64)
    return text[at], item[at], np.concatenate(low), np.concatenate(high)


def _matches(items: Items, hashes: np.ndarray, first: np.ndarray, text: np.ndarray, item: np.ndarray, begin: np.ndarray, least_score: float, block: int = 20_000) -> Iterator[tuple[int, int, float, int, int]]:
    """(text, item, score, first and last word) of the regions that reach the least score; see regions() for the order of hits."""
    text, item, low, high = regions(text, item, begin, items.length)
    least = least_score * MATCH * items.length[item]
    # An alignment that reaches the least score has no room for more gaps than this, so it doesn't leave a..b.
    margin = ((MATCH * items.length[item] - least) / -GAP).astype(np.int64)
    a = np.maximum(first[text], first[text] + low - margin)
    b = np.minimum(first[text + 1], first[text] + high + items.length[item] + margin)
    for x in range(0, len(text), block):
        some = slice(x, x + block)
        for r in x + np.flatnonzero(ceilings(items, hashes, item[some], a[some], b[some]) >= least[some]):
            t, i = int(text[r]), int(item[r])
            score, y, z = align(items.words[i], hashes[a[r] : b[r]])
            if score >= least[r]:
                shift = int(a[r] - first[t])
                yield t, i, score / (MATCH * int(items.length[i])), shift + y, shift + z


@lru_cache(maxsize=16)
def _block(folder: str, block: int) -> tuple[np.ndarray, list[int | None], np.ndarray, np.ndarray]:
    """A block of items, by number: numbers, ids, words of all, each one's first word."""
    rows = _stored(f"{folder}/block={block}", ["item", "id", "words"]).sort_by("item").combine_chunks()
    words = rows["words"].combine_chunks()
    return rows["item"].to_numpy(), rows["id"].to_pylist(), *_lists(words.chunk(0) if isinstance(words, pa.ChunkedArray) else words)


def load_items(folder: str, wanted: np.ndarray) -> Items:
    """The items of these numbers (sorted, unique), in a task."""
    ids, words = [], []
    for block in np.unique(wanted >> 33).tolist():
        number, own, flat, first = _block(folder, block)
        for i in np.searchsorted(number, wanted[wanted >> 33 == block]).tolist():
            ids.append(own[i])
            words.append(flat[first[i] : first[i + 1]])
    return Items(wanted, ids, words)


@lru_cache(maxsize=2)
def _openings(folder: str, file: int, part: int) -> tuple[np.ndarray, ...]:
    """row, item, begin of the hits in some rows of a file, sorted by row and item, then rare seeds first."""
    rows = _stored(f"{folder}/file={file}/part={part}", ["row", "item", "begin", "n"])
    if rows is None:
        return (np.zeros(0, np.int64),) * 3
    row, item, begin, n = (rows[c].to_numpy() for c in ("row", "item", "begin", "n"))
    order = np.lexsort((begin, n, item, row))
    return row[order], item[order], begin[order]


class Seeded:
    """What the join of documents and items on seeds leaves in the shared folder, for tasks to align."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, n: int):
        """docs: text and place; benchmark: id and text."""
        scratch = Scratch(docs.sparkSession, "leaks")
        blocks, self.together = max(1, -(-benchmark.count() // BLOCK)), TOGETHER
        self.items, self.openings, bits = f"{scratch.folder}/items", f"{scratch.folder}/openings", f"{scratch.folder}/filter"
        items = _tokenised(benchmark.repartition(blocks)).withColumn("item", F.monotonically_increasing_id())
        items.withColumn("block", F.shiftright("item", 33)).write.partitionBy("block").parquet(self.items)
        items = docs.sparkSession.read.schema("id long, words array<long>, item long").parquet(self.items)
        seeds = scratch.keep(_seeds(items.select("item", "words"), n), "seeds")
        write_filter(seeds, "seed", bits)
        sizes = sorted(r["size"] for r in seeds.select("size").distinct().collect())
        hits = scratch.keep(_hits(docs, bits, sizes), "hits")
        often = hits.groupBy("seed").agg(F.count("*").alias("n"))
        often = scratch.keep(often.join(seeds.select("seed"), "seed", "left_semi"), "often")
        parts = F.ceil(F.col("n") / EACH)
        known = join_groups(hits, often, ["seed"], "n", "row", inner=True).withColumn("part", F.pmod(F.xxhash64("file", "row"), parts))
        postings = seeds.join(often, "seed").select("seed", "item", "place", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
        pairs = known.join(postings, ["seed", "part"]).groupBy("file", "row", "item", (F.col("word") - F.col("place")).alias("begin")).agg(F.min("n").alias("n"))
        pairs = pairs.withColumn("part", F.floor(F.col("row") / self.together))
        pairs.repartition("file", "part").write.partitionBy("file", "part").parquet(self.openings)
        scratch.drop("seeds", "filter", "hits", "often")

    def leaks(self, text: pa.Array, file: np.ndarray, row: np.ndarray, least_score: float) -> Iterator[tuple[int, int | None, list, int]]:
        """(row of the batch, item's id, best hit, copies) of the items found in a batch of documents."""
        part = row // self.together
        edges = np.flatnonzero(np.concatenate([[True], (file[1:] != file[:-1]) | (part[1:] != part[:-1])])) if len(row) else []
        for a, b in zip(edges, [*edges[1:], len(row)], strict=True):
            rows, item, begin = _openings(self.openings, int(file[a]), int(part[a]))
            lo, hi = np.searchsorted(rows, row[a:b], "left"), np.searchsorted(rows, row[a:b], "right")
            held = np.flatnonzero(hi > lo)
            for x in range(0, len(held), 500):
                some = held[x : x + 500]
                yield from self._found(text.take(pa.array(a + some)), a + some, lo[some], hi[some], item, begin, least_score)

    def _found(self, texts: pa.Array, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, item: np.ndarray, begin: np.ndarray, least_score: float) -> Iterator[tuple[int, int | None, list, int]]:
        base = 0
        for hashes, first in tokens(texts):
            own = range(base, base + len(first) - 1)
            hit = np.concatenate([np.arange(lo[t], hi[t]) for t in own])
            text = np.repeat(np.arange(len(own)), hi[own] - lo[own])
            wanted, number = np.unique(item[hit], return_inverse=True)
            items = load_items(self.items, wanted)
            best: dict[tuple[int, int], list] = {}
            for t, i, *found in sorted(_matches(items, hashes, first, text, number, begin[hit], least_score), key=lambda m: (m[0], m[1], m[3], m[4])):
                old = best.setdefault((t, i), [found, 0, 0])
                old[1] += found[1] >= old[2]  # regions side by side can show one copy
                old[2] = max(old[2], found[2])
                if found[0] > old[0][0]:
                    old[0] = found
            yield from ((int(at[base + t]), items.ids[i], found, copies) for (t, i), (found, copies, _) in best.items())
            base += len(own)


def _seeded(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, n: int) -> tuple[DataFrame, str, Seeded]:
    """docs with the place of each row in a new column, that column's name, and the seeds' join."""
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    place = fresh(docs, "_place")
    docs = with_row_identity(docs, place)
    return docs, place, Seeded(docs.select(F.col(text_col).cast("string").alias("text"), F.col(place).alias("place")), items, n)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = 3, least_score: float = 0.5
) -> DataFrame:
    """Leaks: id_col, item_col, score, start_word, end_word, n_copies; one row per document and item.

    The n-word runs of test items are seeds, in a table. One pass over the documents gives their runs that a filter of all
    seeds' hashes lets through (16 MB, whatever their number), and these hits join the seeds; counts of hits over all documents are the
    seeds' rarity. In each document the hits of an item open regions, those of the rarest seed first: a hit that lies
    within an item's length of a region joins it. A second pass, in which each task looks up the hits of its own rows, aligns item
    and region word by word (Smith-Waterman: match 2, mismatch and gap -1). Rarity is an order and no threshold: one seed is
    enough, however many documents hold it; a region is left out only if ceilings() shows that no alignment there can reach
    `least_score` of the item's own score. One that reaches it is a leak: exact, cut, edited or
    paraphrased copies with one n-word run intact. score is 1 for an exact copy; n_copies counts the
    alignments of regions that don't overlap, of which the row shows the best (ties: the first).

    Neither texts nor items are shuffled, only hits; a seed's hits are dealt to tasks by the hundred thousand. Tasks hold the
    hits of a million rows of a file, and items in blocks, so their memory is bounded for any number of items (whose texts are items,
    not corpora), and none passes through the driver.

    Words are runs of letters and digits, lower-cased. Null, empty or wordless texts and items give no
    leak, an empty table gives no rows. Very long texts are searched whole, one at a time. Items shorter than n
    words are one seed. Repeated documents give their rows again; repeated items their own rows per row; null ids
    are kept as null. Other columns are ignored, whatever their names.
    """
    docs, place, seeded = _seeded(docs, benchmark, text_col, item_col, item_text_col, n)

    def match(batches):
        for batch in batches:
            ids = batch.column(0)
            out = [(ids[t].as_py(), item, *hit, copies) for t, item, hit, copies in seeded.leaks(batch.column(1), *_place(batch.column(2)), least_score)]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["a", "b", "c", "d", "e", "f"])

    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(place).alias("place"))
    return docs.mapInArrow(match, f"`{id_col}` long, `{item_col}` long, score double, start_word long, end_word long, n_copies long")


def _place(column: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    return column.field(0).to_numpy(), column.field(1).to_numpy()


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = 3, least_score: float = 0.5) -> DataFrame:
    """docs without the rows in which find_leaks() finds a test item, in the pass that aligns.

    Rows are judged one by one, so null and repeated ids are as good as others; null and empty texts stay.
    All columns are kept.
    """
    kind, at, width = docs.schema, docs.columns.index(text_col), len(docs.columns)
    placed, _, seeded = _seeded(docs, benchmark, text_col, item_col, item_text_col, n)

    def clean(batches):
        for batch in batches:
            stays = np.ones(batch.num_rows, bool)
            stays[[t for t, *_ in seeded.leaks(batch.column(at), *_place(batch.column(width)), least_score)]] = False
            yield batch.select(range(width)).filter(pa.array(stays))

    return placed.mapInArrow(clean, kind)
