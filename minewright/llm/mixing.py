"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from minewright.llm.common import ALIKE, WORD, materialize, new_path, with_copy_number

NAMES = ("size", "source_size", "target", "taken", "draws")


def targets(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), ratio: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sources (source, source_size) plus rank and target.

    Sources in code-point order, null last, take the weights in turn. They share ratio * all sizes by
    weight; a target stops at cap * source_size and the excess goes to the others by weight, until
    none is above. With level L, that is target = min(weight * L, cap * source_size), and L is found
    from running sums in the order in which sources reach their caps. One row per source, so these
    windows without partitions see no more rows than there are sources.
    """
    every = W.orderBy(F.col("source").asc_nulls_last())
    s = sources.withColumn("rank", F.row_number().over(every))
    s = s.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("_cap", F.col("source_size") * cap).withColumn("_reach", F.col("_cap") / F.col("_w"))
    order = W.orderBy("_reach", "rank")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    whole = W.orderBy("_reach", "rank").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumn("_open", F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    s = s.withColumn("_left", F.sum("source_size").over(whole) * ratio - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
    s = s.withColumn("_level", F.col("_left") / F.col("_open"))
    free = F.when(F.col("_reach") > F.col("_level"), F.col("_level"))
    s = s.withColumn("_level", F.first(free, ignorenulls=True).over(whole))
    return s.select("source", "source_size", "rank", F.least(F.col("_w") * F.coalesce("_level", "_reach"), F.col("_cap")).alias("target"))


def _log_factorial(x: str) -> str:
    """Stirling's series; exact for 0 and 1."""
    return f"(CASE WHEN {x} < 2 THEN 0D ELSE ({x} + 0.5D) * ln({x}) - {x} + 0.9189385332046727D + 1D / (12D * {x}) - 1D / (360D * power({x}, 3D)) + 1D / (1260D * power({x}, 5D)) END)"


def _log_choose(n: str, k: str) -> str:
    return f"({_log_factorial(n)} - {_log_factorial(k)} - {_log_factorial(f'({n} - {k})')})"


def hypergeometric(total: str, good: str, drawn: str, u: str) -> str:
    """SQL for one hypergeometric draw (bigint) from a uniform number.

    Inversion that walks outwards from the mode, whose probability comes from log-factorials, until
    the summed probability passes u. All arguments are SQL expressions without side effects.
    """
    t, g, d = "p.t", "p.g", "p.d"
    mode = f"floor((({d} + 1D) * ({g} + 1D)) / ({t} + 2D))"
    steps = f"cast(20 + 12 * sqrt({d} * ({g} / greatest({t}, 1D)) * (1 - {g} / greatest({t}, 1D))) as int)"
    walk = f"""aggregate(sequence(1, {steps}),
        named_struct('u', p.u - q.p0, 'up', q.p0, 'down', q.p0, 'x', CASE WHEN p.u <= q.p0 THEN q.m END),
        (a, i) -> CASE WHEN a.x IS NOT NULL THEN a ELSE
          element_at(transform(array(named_struct(
            'up', CASE WHEN q.m + i > least({g}, {d}) THEN 0D ELSE a.up * ({g} - q.m - i + 1D) * ({d} - q.m - i + 1D) / ((q.m + i) * ({t} - {g} - {d} + q.m + i)) END,
            'down', CASE WHEN q.m - i < greatest(0D, {d} + {g} - {t}) THEN 0D ELSE a.down * (q.m - i + 1D) * ({t} - {g} - {d} + q.m - i + 1D) / (({g} - q.m + i) * ({d} - q.m + i)) END)),
            s -> named_struct('u', a.u - s.up - s.down, 'up', s.up, 'down', s.down,
                              'x', CASE WHEN a.u <= s.up THEN q.m + i WHEN a.u <= s.up + s.down THEN q.m - i END)), 1) END,
        a -> cast(coalesce(a.x, q.m) as bigint))"""
    p0 = f"exp({_log_choose(g, 'm')} + {_log_choose(f'({t} - {g})', f'({d} - m)')} - {_log_choose(t, d)})"
    return f"""element_at(transform(array(named_struct('t', cast({total} as double), 'g', cast({good} as double), 'd', cast({drawn} as double), 'u', {u})),
        p -> element_at(transform(transform(array({mode}), m -> named_struct('m', cast(m as double), 'p0', {p0})), q -> {walk}), 1)), 1)"""


def split_tree(quotas: DataFrame, shards: int, seed: int, fan: int = 256) -> DataFrame:
    """Split block quotas (_src, rank 1, 2, ..., _q) among shards: _src, _bounds.

    A node holds the quotas of sources for a range of shards, and hands its left half of the shards a
    multivariate-hypergeometric draw of them (source by source, each conditioned on the draws before);
    the rest goes right. So every shard gets its share of all blocks, the sources in it as a random draw
    without replacement would have them, and each source's quota is kept exactly. _bounds[i] is the
    number of the source's blocks in shards 0..i.

    A row holds at most `fan` sources. Where there are more, the tree first splits the sums of groups of
    sources, and each group then draws what its sum was given, node by node; that is the same distribution.
    """
    grouped = quotas.withColumn("_group", F.expr(f"cast((rank - 1) div {fan} as long)"))
    node = grouped.groupBy("_group").agg(F.sort_array(F.collect_list(F.struct("rank", "_src", "_q"))).alias("_all"))
    node = node.select("_group", F.transform("_all", lambda x: x["_src"]).alias("_srcs"), F.transform("_all", lambda x: x["_q"]).alias("_qs"))
    if quotas.count() > fan:
        sums = grouped.groupBy("_group").agg(F.sum("_q").alias("_q")).select(F.col("_group").alias("_src"), (F.col("_group") + 1).alias("rank"), "_q")
        given = split_tree(sums, shards, seed + 1, fan).select(F.col("_src").alias("_group"), F.col("_bounds").alias("_given"))
        node = materialize(node.join(given, "_group"), "groups")
        # The blocks that the left half of a node's shards was given, from the bounds of the group.
        left_sum = "element_at(_given, cast(_first + _count div 2 as int)) - if(_first = 0, 0L, element_at(_given, greatest(_first, 1)))"
    else:
        node = node.withColumn("_given", F.expr("cast(NULL as array<bigint>)"))
        left_sum = "cast(floor(_sum * (_count div 2) / _count) as bigint)"
    node = node.withColumns({"_first": F.lit(0), "_count": F.lit(shards)})
    uniform = f"(cast(shiftrightunsigned(xxhash64({seed}L, _group, _first, _count, i), 11) as double) / 9007199254740992D)"
    draw = f"""aggregate(sequence(0, size(_qs) - 1),
        named_struct('left', {left_sum}, 'rest', _sum, 'out', cast(array() as array<bigint>)),
        (a, i) -> element_at(transform(array({hypergeometric('a.rest', '_qs[i]', 'a.left', uniform)}),
                   x -> named_struct('left', a.left - x, 'rest', a.rest - _qs[i], 'out', array_append(a.out, x))), 1),
        a -> a.out)"""
    for _ in range((shards - 1).bit_length()):
        summed = node.withColumn("_sum", F.expr("aggregate(_qs, 0L, (a, x) -> a + x)"))
        drawn = summed.withColumn("_left", F.expr(f"CASE WHEN _count > 1 THEN {draw} ELSE _qs END"))
        half = "named_struct('qs', {}, 'first', {}, 'count', {})"
        left = half.format("_left", "_first", "greatest(1, _count div 2)")
        right = half.format("zip_with(_qs, _left, (x, y) -> x - y)", "_first + _count div 2", "_count - _count div 2")
        node = drawn.select("_group", "_given", "_srcs", F.explode(F.expr(f"CASE WHEN _count > 1 THEN array({left}, {right}) ELSE array({left}) END")).alias("_n"))
        node = node.select("_group", "_given", "_srcs", F.col("_n.qs").alias("_qs"), F.expr("cast(_n.first as int)").alias("_first"), F.expr("cast(_n.count as int)").alias("_count"))
    leaf = node.select("_first", F.explode(F.arrays_zip("_srcs", "_qs")).alias("_x")).select("_first", F.col("_x._srcs").alias("_src"), F.col("_x._qs").alias("_q"))
    running = "transform(sequence(1, size(_shares)), n -> aggregate(slice(_shares, 1, n), 0L, (a, x) -> a + x._q))"
    return leaf.groupBy("_src").agg(F.sort_array(F.collect_list(F.struct("_first", "_q"))).alias("_shares")).select("_src", F.expr(running).alias("_bounds"))


def permuted(x: str, n: str, key: str, rounds: int = 32) -> str:
    """SQL for the place of x in a keyed random order of 0 .. n - 1, n at least 1.

    Swap-or-not rounds: each pairs x with a keyed partner, and a keyed bit of the pair decides whether they
    swap. So it is a permutation of any n, found for one x without a table of the others.
    """
    partner = f"pmod(pmod(xxhash64({key}, r), {n}) - x, {n})"
    return f"""aggregate(sequence(1, {rounds}), {x}, (x, r) -> element_at(transform(array({partner}),
        y -> CASE WHEN xxhash64({key}, r, greatest(x, y)) % 2 = 0 THEN x ELSE y END), 1))"""


def _draws(block: int, seed: int) -> str:
    """SQL for the draws of a document of `size` words from word _start of its source's stream."""
    place = f"CASE WHEN b < source_size div {block} THEN {permuted('b', f'(source_size div {block})', f'{seed}L, _src, p')} ELSE _blocks - 1 END"
    begin, end = f"greatest(0L, b * {block} - _start)", f"least(size, (b + 1) * {block} - _start)"
    given = f"CASE WHEN p < _full THEN {end} ELSE least({end}, b * {block} + _more - at * {block} - _start) END"  # a pass that isn't full ends within a block
    piece = f"transform(array({place}), at -> named_struct('start', {begin}, 'words', {given} - {begin}, 'shard', size(filter(_bounds, x -> x <= p * _blocks + at))))[0]"
    pieces = f"filter(transform(sequence(_start div {block}, (_start + size - 1) div {block}), b -> {piece}), x -> x.words > 0)"
    whole = "CASE WHEN size(x) > 0 THEN array(named_struct('start', 0L, 'words', aggregate(x, 0L, (a, y) -> a + y.words), 'shard', x[0].shard)) ELSE x END"
    drawn = f"transform(array({pieces}), x -> CASE WHEN size > {block} THEN x ELSE {whole} END)[0]"
    entry = f"named_struct('pass', p, 'start', x.start, 'words', x.words, 'shard', x.shard, 'place', xxhash64({seed}L, _hash, p, x.start))"
    every = f"flatten(transform(sequence(0L, _full), p -> transform({drawn}, x -> {entry})))"
    none = "cast(array() as array<struct<pass:bigint,start:bigint,words:bigint,shard:int,place:bigint>>)"
    return f"CASE WHEN size > 0 THEN {every} ELSE {none} END"


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1),
    ratio: float = 1.5, cap: float = 2.0, shards: int = 8, block_words: int = 1024, buckets: int | None = None, seed: int = 29,
) -> DataFrame:
    """docs plus size, source_size, target, taken and draws.

    size: words of the text (null: 0). target: see targets(). The words of a source form a stream, its
    documents in seeded random order, cut into blocks of block_words words. A pass draws the source's blocks in an order
    of its own, a random permutation (see permuted(); only the last block of the stream, which may be shorter, stays last); there are as many
    full passes as the target holds the source, and one more up to the target. split_tree() deals the numbers
    of blocks to draw to the output shards, and a shard draws the next so many blocks of each source's order: so shards are disjoint
    in every pass, the tree's quotas are kept exactly, targets are met to the word and no document exceeds cap times its size.
    A document longer than a block goes block by block; one that isn't stays together in a pass: it takes its first words, as many as
    the one or two blocks around it give it (all, if they are drawn), in the shard of the first of them that is drawn.
    draws: an array of (pass, start, words, shard, place), one entry per part that is taken: `words` words of the
    text from word `start` (from 0). Sorting a shard by place shuffles it, as in_shard_order() does.

    Places in a stream are running sums in two levels (hash buckets, then within a bucket), so a source
    that holds most rows is spread. Without `buckets` there are so many that one holds about 32 MB of text,
    64 at least. Nulls: a null source is a source, ordered last; null ids and texts are allowed. Repeated rows are
    documents of their own: rows that are alike in id and text share a bucket, in which they tie. If they are many, they are numbered among
    themselves (see with_copy_number()), and the number is part of their hash, so that they are spread and the result is the same however rows are dealt: which of the alike
    rows gets which share is open, but nothing else. Very long texts: a text must fit into a row. Input columns with the names that are
    added are replaced, others kept, whatever their names. Empty tables and empty sources give targets of 0.
    """
    names = [c for c in docs.columns if c.lower() not in NAMES]
    docs = docs.select(*names).toDF(*(inner := [f"c{i}" for i in range(len(names))]))
    key, text, source = (inner[names.index(c)] for c in (id_col, text_col, source_col))
    hashed = F.xxhash64(F.lit(seed), F.col(key), F.crc32(F.col(text).cast("binary")))
    same = docs.groupBy(hashed.alias("h")).agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)).cast("long")).alias("bytes"), F.count("*").alias("n"))
    total, most = same.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    if most > ALIKE:
        docs = with_copy_number(docs, "copy", F.col(key), F.col(text))
        hashed = F.when(F.col("copy") == 0, hashed).otherwise(F.xxhash64(F.lit(seed), F.col(key), F.crc32(F.col(text).cast("binary")), F.col("copy")))
    buckets = buckets or max(64, total >> 25)
    d = docs.withColumns({
        "size": F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long"),
        "_src": F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("null")),
        "_hash": hashed,
    }).withColumn("_bucket", F.pmod("_hash", F.lit(buckets)))
    sums = materialize(d.groupBy(F.col(source).alias("source"), "_src", "_bucket").agg(F.sum("size").alias("_sum")), "sums")
    plan = targets(sums.groupBy("source", "_src").agg(F.sum("_sum").alias("source_size")).select("source", "source_size"), weights, ratio, cap)
    plan = plan.withColumn("_src", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")))
    plan = plan.withColumn("_words", F.round("target").cast("long")).withColumns({
        "_full": F.expr("_words div greatest(source_size, 1)"), "_more": F.expr("_words % greatest(source_size, 1)"),
        "_blocks": F.expr(f"(source_size + {block_words - 1}) div {block_words}"),
    })
    plan = materialize(plan.withColumn("_q", F.expr(f"_full * _blocks + (_more + {block_words - 1}) div {block_words}")), "targets")
    bounds = plan.select("_src", "source_size", "target", "_full", "_more", "_blocks").join(split_tree(plan.select("_src", "rank", "_q"), shards, seed), "_src")
    before = W.partitionBy("_src").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    placed = sums.drop("source").withColumn("_offset", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum").join(bounds, "_src")
    placed = materialize(placed, "places")
    within = W.partitionBy("_src", "_bucket").orderBy("_hash", F.col(key), "size").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum("size").over(within), F.lit(0)) + F.col("_offset")
    # A task takes some 16 MB of text, more only where that would make too many tasks.
    parts = max(2 * docs.sparkSession.sparkContext.defaultParallelism, min(total >> 24, 50_000))
    d = d.repartition(parts, "_src", "_bucket").join(placed, ["_src", "_bucket"]).withColumn("_start", start)
    d = d.withColumn("draws", F.expr(_draws(block_words, seed)))
    taken = F.expr("aggregate(draws, 0L, (a, x) -> a + x.words)")
    return d.select(*[F.col(i).alias(c) for i, c in zip(inner, names, strict=True)], "size", "source_size", "target", taken.alias("taken"), "draws")


def mixed_texts(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """The mix itself: mix()'s input columns, one row per draw, plus shard and place.

    A draw of all words keeps the text as it is; one of fewer has its words with single spaces between. Input columns
    named shard or place are replaced.
    """
    names = [c for c in mixed.columns if c not in NAMES and c.lower() not in ("shard", "place")]
    words = F.when(F.exists("draws", lambda x: x["words"] < F.col("size")), F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0)))
    cut = lambda w, x: F.array_join(F.slice(w, (x["start"] + 1).cast("int"), x["words"].cast("int")), " ")
    text = lambda w, x: F.when(x["words"] == F.col("size"), F.col(text_col)).otherwise(cut(w, x))
    # A text is taken apart once, before its draws become rows.
    draws = F.transform(F.array(words), lambda w: F.transform("draws", lambda x: F.struct(text(w, x).alias("text"), x["shard"].alias("shard"), x["place"].alias("place"))))[0]
    rows = mixed.select(*[c for c in names if c != text_col], F.explode(draws).alias("_draw"))
    return rows.select(*[F.col("_draw.text").alias(c) if c == text_col else F.col(c) for c in names], "_draw.shard", "_draw.place")


def in_shard_order(mixed: DataFrame, text_col: str = "text", shards: int = 8) -> DataFrame:
    """mixed_texts(), shuffled: partition by partition, shards one after the other and each in order of place.

    Places are uniform, so equal ranges of them are equal parts of a shard.
    """
    spark = mixed.sparkSession
    parts = -(-max(shards, 2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))) // shards)
    nth = F.floor((F.shiftright("place", 32) + (1 << 31)) * parts / (1 << 32))
    return mixed_texts(mixed, text_col).repartitionById(parts * shards, (F.col("shard") * parts + nth).cast("int")).sortWithinPartitions("shard", "place")


def write_mix(mixed: DataFrame, text_col: str = "text", shards: int = 8) -> DataFrame:
    """in_shard_order(), written to the shared folder, a folder per shard and its files in order of place, and read back."""
    rows, path = in_shard_order(mixed, text_col, shards), new_path(mixed.sparkSession, "mix")
    rows.write.partitionBy("shard").parquet(path)
    return mixed.sparkSession.read.schema(rows.schema).parquet(path)
