"""Language ID: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from minewright.llm import textnum as tn

UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def segment_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i+1]], 0 for empty ones."""
    out = np.zeros(len(first) - 1)
    full = np.flatnonzero(first[1:] > first[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, first[full])
    return out


def ngrams(chunk: tn.Chunk, sizes: tuple[int, ...], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size: the buckets of all character n-grams with a letter, and each text's first one.

    The chunk is lower-case; characters other than letters count as one and the same.
    """
    code = np.frombuffer(chunk.data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    first = np.concatenate([[0], np.cumsum((chunk.data & 0xC0) != 0x80)])[chunk.offsets]
    letter = _letters()[code]
    code = np.where(letter, code, 0)
    for n in sizes:
        m = len(code) - n + 1
        if m <= 0:
            yield np.zeros(0, np.int64), np.zeros(len(first), np.int64)
            continue
        h, keep = np.full(m, n, np.uint32), np.zeros(m, bool)
        for k in range(n):
            h = (h ^ code[k : k + m]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            keep |= letter[k : k + m]
        for k in range(1, n):
            at = first[1:-1] - k
            keep[at[(at >= 0) & (at < m)]] = False
        starts = np.concatenate([[0], np.cumsum(keep)])[np.minimum(first, m)]
        yield (h[keep] % np.uint32(buckets)).astype(np.int64), starts


@dataclass
class Model:
    """log_prob: languages x buckets; prior: by language. Sizes and buckets as trained."""

    languages: list[str]
    log_prob: np.ndarray
    prior: np.ndarray
    sizes: tuple[int, ...]
    buckets: int

    def score(self, column: pa.Array | pa.ChunkedArray) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text and its posterior probability."""
        names, scores = [], []
        for chunk in tn.chunks(column, lower=True):
            total = np.zeros((len(chunk), len(self.languages)))
            some = np.zeros(len(chunk), bool)
            for bucket, first in ngrams(chunk, self.sizes, self.buckets):
                some |= first[1:] > first[:-1]
                for k in range(len(self.languages)):
                    total[:, k] += segment_sums(self.log_prob[k][bucket], first)
            if not self.languages:
                names += [UNKNOWN] * len(chunk)
                scores.append(np.zeros(len(chunk)))
                continue
            total += self.prior
            best = total.argmax(1)
            share = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
            names += [self.languages[k] if ok else UNKNOWN for k, ok in zip(best, some, strict=True)]
            scores.append(np.where(some, share, 0.0))
        return names, np.concatenate([np.zeros(0), *scores])


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sizes: tuple[int, ...] = (1, 2, 3), buckets: int = 1 << 15, alpha: float = 0.5, max_languages: int = 500) -> Model:
    """Count n-grams by language over all rows of docs with a language.

    Tasks count; what is shuffled are summed counts by language and bucket, and what is collected is a row per
    language with an array of at most `buckets` counts (more than max_languages languages raise ValueError). Null
    texts are empty; very long ones are counted whole, one at a time; repeated rows count again. Ids and other
    columns don't matter. An empty table gives a model without languages.
    """

    def work(batches):
        known: dict[str, int] = {}
        counts, texts = np.zeros((0, buckets), np.int64), np.zeros(0, np.int64)
        for batch in batches:
            code = np.array([known.setdefault(x, len(known)) for x in batch.column(1).to_pylist()], np.int64)
            if len(known) > max_languages:
                raise ValueError(f"more than {max_languages} languages")
            counts = np.concatenate([counts, np.zeros((len(known) - len(counts), buckets), np.int64)])
            texts = np.concatenate([texts, np.zeros(len(known) - len(texts), np.int64)]) + np.bincount(code, minlength=len(known))
            for chunk in tn.chunks(batch.column(0), lower=True):
                own = code[chunk.first : chunk.first + len(chunk)]
                for bucket, first in ngrams(chunk, sizes, buckets):
                    cell, n = np.unique(np.repeat(own, np.diff(first)) * buckets + bucket, return_counts=True)
                    counts.reshape(-1)[cell] += n
        names = np.array(list(known), object)
        row, bucket = np.nonzero(counts)
        # The number of texts stands in the bucket behind the last one.
        lang, place, n = np.concatenate([names[row], names]), np.concatenate([bucket, np.full(len(names), buckets)]), np.concatenate([counts[row, bucket], texts])
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(place), pa.array(n)], ["lang", "bucket", "n"])

    rows = docs.filter(F.col(lang_col).isNotNull()).select(F.col(text_col).cast("string"), F.col(lang_col).cast("string"))
    summed = rows.mapInArrow(work, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = summed.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("x")).orderBy("lang").limit(max_languages + 1).toArrow()
    languages = sorted(found["lang"].to_pylist())
    if len(languages) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    counts = np.zeros((len(languages), buckets + 1))
    for lang, x in zip(found["lang"].to_pylist(), found["x"].combine_chunks() if len(languages) else [], strict=True):
        counts[languages.index(lang), x.values.field(0).to_numpy()] = x.values.field(1).to_numpy()
    grams, texts = counts[:, :-1] + alpha, counts[:, -1]
    return Model(languages, np.log(grams) - np.log(grams.sum(1, keepdims=True)), np.log(texts + 1) - np.log(texts.sum() + max(1, len(languages))), sizes, buckets)


def identify(docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs plus the predicted language and its probability; the text is all that is looked at.

    Texts that are null or have no letter get "und" and 0. Of languages that are equally likely, the first by name
    is taken. Very long texts are scored whole, a chunk of texts or one long text at a time; repeated rows alike.
    Columns of the added names are replaced, others kept. An empty table gives no rows. The
    model (languages x buckets numbers, bounded by train()) is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select(*[c for c in docs.columns if c.lower() not in names])
    at = docs.columns.index(text_col)

    def work(batches):
        for batch in batches:
            lang, score = shared.value.score(batch.column(at).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score)], [*batch.schema.names, *names])

    schema = T.StructType([*docs.schema, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return docs.mapInArrow(work, schema)


def held_out(id_col: str, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text, modulo parts, is part; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(parts)) == part
