"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy."""

from __future__ import annotations

import pickle
import uuid
from dataclasses import dataclass, field, replace
from functools import cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from minewright.llm import textnum as tn
from minewright.llm.common import new_path
from minewright.llm.language_id import segment_sums

PREFIXES = (4, 5)  # bytes of a word's start that are hashed besides the word


def token_buckets(chunk: tn.Chunk, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(words x 3) buckets of each word and its starts, and each text's first word."""
    w = tn.words(chunk, tn.ALNUM)
    sums = tn.prefix_sums(chunk.data)
    ids = [tn.span_hashes(sums, w.start, w.end)]
    ids += [tn.span_hashes(sums, w.start, np.minimum(w.end, w.start + n)) + tn.U64(n * 0x9E3779B97F4A7C15 % 2**64) for n in PREFIXES]
    return np.stack([(tn.mix64(x) % tn.U64(buckets)).astype(np.int32) for x in ids], 1), w.first


@dataclass
class Network:
    """Embedding, one filter bank per width, max pooling, a logistic unit.

    project: what each bucket adds to each filter at each offset, the form in which texts are scored.
    """

    widths: tuple[int, ...]
    filters: int
    embedding: np.ndarray
    banks: list[np.ndarray]
    out: np.ndarray
    bias: float
    languages: list[str] = field(default_factory=list)
    word_log_prob: np.ndarray | None = None
    thresholds: np.ndarray | None = None
    project: np.ndarray | None = None

    def freeze(self) -> Network:
        self.project = np.concatenate([self.embedding @ bank[k] for bank in self.banks for k in range(bank.shape[0])], 1).astype(np.float32)
        return self

    def logits(self, tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
        """One per text. Positions past a text's end add nothing; an empty text has the bias."""
        pooled = np.zeros((len(first) - 1, len(self.widths) * self.filters), np.float32)
        full = np.flatnonzero(first[1:] > first[:-1])
        if len(full):
            rows = self.project[tokens[:, 0]]
            for k in range(1, tokens.shape[1]):
                rows += self.project[tokens[:, k]]
            left = np.repeat(first[1:], np.diff(first)) - np.arange(len(tokens))  # words to the text's end
            at = 0
            for j, width in enumerate(self.widths):
                z = rows[:, at : at + self.filters].copy()
                for k in range(1, width):
                    z[:-k] += rows[k:, at + k * self.filters : at + (k + 1) * self.filters] * (left[:-k] > k)[:, None]
                at += width * self.filters
                pooled[full, j * self.filters : (j + 1) * self.filters] = np.maximum.reduceat(z, first[full], axis=0)
        return np.maximum(pooled, 0) @ self.out + self.bias

    def language(self, tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Each text's likeliest language, by number, from its words alone."""
        total = np.stack([segment_sums(log[tokens[:, 0]], first) for log in self.word_log_prob], 1) if self.languages else np.zeros((len(first) - 1, 1))
        return total.argmax(1)

    def scores(self, column: pa.Array | pa.ChunkedArray) -> np.ndarray:
        """0 to 1; 0.5 stands at the threshold of the text's language."""
        out = [np.zeros(0)]
        for chunk in tn.chunks(column, 1 << 17, lower=True):
            tokens, first = token_buckets(chunk, len(self.embedding))
            logit = self.logits(tokens, first) - self.thresholds[self.language(tokens, first)]
            out.append(1 / (1 + np.exp(-np.clip(logit, -40, 40))))
        return np.concatenate(out)


def _texts(column: pa.Array, buckets: int) -> list[np.ndarray]:
    out = []
    for chunk in tn.chunks(column, lower=True):
        tokens, first = token_buckets(chunk, buckets)
        out += [tokens[first[i] : first[i + 1]] for i in range(len(chunk))]
    return out


@dataclass
class Batch:
    """The forward pass of some texts, laid end to end: what the backward pass needs."""

    tokens: np.ndarray  # words x parts
    keep: np.ndarray  # words x parts: parts that aren't left out
    x: np.ndarray  # words x dim
    end: np.ndarray  # per text, the word behind its last
    pooled: np.ndarray  # texts x all filters
    spots: np.ndarray  # the words at which the maxima stand


def forward(net: Network, texts: list[np.ndarray], keep: np.ndarray | None = None) -> Batch:
    """Embed, convolve and pool. A filter sees nothing behind its text's end; a text without words has 0."""
    size = np.array([len(t) for t in texts])
    end = np.cumsum(size)
    tokens = np.concatenate(texts)
    keep = np.ones(tokens.shape, bool) if keep is None else keep
    x = np.einsum("wpd,wp->wd", net.embedding[tokens], keep)
    left = np.repeat(end, size) - np.arange(len(tokens))
    pooled = np.zeros((len(texts), len(net.out)))
    spots = np.zeros(pooled.shape, np.int64)
    full = np.flatnonzero(size)
    first = (end - size)[full]
    for j, bank in enumerate(net.banks if len(full) else []):
        z = x @ bank[0]
        for k in range(1, len(bank)):
            z[:-k] += (x[k:] @ bank[k]) * (left[:-k] > k)[:, None]
        own = slice(j * net.filters, (j + 1) * net.filters)
        top = np.maximum.reduceat(z, first, axis=0)
        pooled[full, own] = top
        there = np.where(z == np.repeat(top, size[full], axis=0), np.arange(len(z))[:, None], len(z))
        spots[full, own] = np.minimum.reduceat(there, first, axis=0)
    return Batch(tokens, keep, x, end, pooled, spots)


def backward(net: Network, b: Batch, back: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Gradients of the filter banks, and of the embedding rows that were touched: (banks, rows, their gradients).

    back: texts x filters, the loss by the pooled values. Only the words at a maximum take part.
    """
    banks, rows, deltas = [], [np.zeros(0, np.int32)], [np.zeros((0, net.embedding.shape[1]))]
    for j, bank in enumerate(net.banks):
        own = slice(j * net.filters, (j + 1) * net.filters)
        g, spot = back[:, own], b.spots[:, own]
        grad = np.zeros_like(bank)
        text, f = np.nonzero(g)
        for k in range(len(bank)):
            at = spot[text, f] + k
            inside = at < b.end[text]
            t, i, at = text[inside], f[inside], at[inside]
            np.add.at(grad[k].T, i, g[t, i, None] * b.x[at])
            delta = g[t, i, None] * bank[k].T[i]
            on = b.keep[at]
            rows.append(b.tokens[at][on])
            deltas.append(np.repeat(delta, on.sum(1), axis=0))
        banks.append(grad)
    rows, where = np.unique(np.concatenate(rows), return_inverse=True)
    summed = np.zeros((len(rows), net.embedding.shape[1]))
    np.add.at(summed, where, np.concatenate(deltas))
    return banks, rows, summed


def fit(texts: pa.Array, labels: np.ndarray, langs: list[str | None], buckets: int = 1 << 15, dim: int = 16, widths: tuple[int, ...] = (1, 2, 3), filters: int = 8, epochs: int = 12, drop: float = 0.3, rate: float = 0.05, batch: int = 32, seed: int = 7) -> Network:
    """Train on whole texts by Adagrad on the log-loss, a batch of texts at a time; one text in five is kept aside.

    A word's vector is the sum of three hashed ones, for the word and two lengths of its start; each is left
    out with probability `drop` while training, so that starts carry unknown words.

    One embedding coordinate starts as the bucket's smoothed log-odds of the label, the others at
    random; training adds what depends on words together. The network of the epoch with the least loss aside is
    kept. Thresholds are then calibrated by language: the cut with the fewest errors among the logits aside of
    texts taken for that language; a language with fewer than ten texts of either label there gets the cut of
    all. The language of a text is inferred from its words by counts over the same texts; of languages that are
    equally likely, the first by name.
    """
    rng = np.random.default_rng(seed)
    docs = _texts(texts, buckets)
    n, used = len(docs), np.arange(len(docs)) % 5 != 4
    odds = np.zeros((2, buckets))
    for x, y, u in zip(docs, labels, used, strict=True):
        if u:
            odds[y, np.unique(x)] += 1
    share = (odds + 2.0 * odds.sum(0) / max(1, odds.sum()) + 1e-3) / (np.array([[(labels[used] == 0).sum()], [(labels[used] == 1).sum()]]) + 2.0)
    trust = odds.sum(0) / (odds.sum(0) + 5.0)
    embedding = rng.normal(0, 0.05, (buckets, dim))
    embedding[:, 0] = np.clip(np.log(share[1] / share[0]), -4, 4) * trust / 2
    banks = [rng.normal(0, 0.2, (w, dim, filters)) for w in widths]
    for bank in banks:
        bank[0, 0] = np.abs(bank[0, 0]) + 0.5
    net = Network(widths, filters, embedding, banks, np.full(len(widths) * filters, 0.1), -1.0)
    grads = {id(x): np.full(x.shape, 1e-6) for x in [embedding, *banks, net.out]}
    bias_grad, best = 1e-6, None
    weight = np.where(labels == 1, n / max(1, 2 * (labels == 1).sum()), n / max(1, 2 * (labels == 0).sum()))

    def step(x, g, at=slice(None)):
        grads[id(x)][at] += g * g
        x[at] -= rate * g / np.sqrt(grads[id(x)][at])

    train = np.flatnonzero(used)
    aside = np.flatnonzero(~used)
    both = len(np.unique(labels[train])) == 2
    for _ in range(epochs if both else 0):
        rng.shuffle(train)
        for at in range(0, len(train), batch):
            ids = train[at : at + batch]
            some = [docs[i] for i in ids]
            b = forward(net, some, rng.random((sum(map(len, some)), docs[0].shape[1])) >= drop)
            active = np.maximum(b.pooled, 0)
            p = 1 / (1 + np.exp(-np.clip(active @ net.out + net.bias, -40, 40)))
            d = (p - labels[ids]) * weight[ids] / len(ids)
            bank_grads, rows, deltas = backward(net, b, d[:, None] * net.out[None, :] * (b.pooled > 0))
            step(net.out, active.T @ d + 1e-4 * net.out)
            bias_grad += d.sum() ** 2
            net.bias -= rate * d.sum() / np.sqrt(bias_grad)
            for bank, g in zip(banks, bank_grads, strict=True):
                step(bank, g + 1e-4 * bank)
            step(embedding, deltas, rows)
        z = _logits(net.freeze(), docs, aside)
        loss = (np.logaddexp(0, np.where(labels[aside] == 1, -z, z)) * weight[aside]).mean() if len(aside) else 0.0
        if best is None or loss <= best[0]:
            best = (loss, embedding.copy(), [b.copy() for b in banks], net.out.copy(), net.bias)
    if best:
        _, net.embedding, net.banks, net.out, net.bias = best
    else:  # one label only: the score is its share
        net.out[:] = 0
        net.bias = 4.0 if n and labels.mean() > 0.5 else -4.0
    net.freeze()
    net.languages = sorted({x for x in langs if x is not None})
    counts = np.full((max(1, len(net.languages)), buckets), 0.1)
    for x, lang in zip(docs, langs, strict=True):
        if lang is not None:
            counts[net.languages.index(lang)] += np.bincount(x[:, 0], minlength=buckets)
    net.word_log_prob = np.log(counts / counts.sum(1, keepdims=True))
    net.thresholds = np.zeros(len(counts))
    if both and len(aside):
        z, y = _logits(net, docs, aside), labels[aside]
        guess = np.array([net.language(docs[i], np.array([0, len(docs[i])]))[0] for i in aside])
        net.thresholds[:] = _cut(z, y)
        for k in range(len(counts)):
            own = guess == k
            if min((y[own] == 1).sum(), (y[own] == 0).sum()) >= 10:
                net.thresholds[k] = _cut(z[own], y[own])
    return net


def _logits(net: Network, docs: list[np.ndarray], ids: np.ndarray) -> np.ndarray:
    return np.array([net.logits(docs[i], np.array([0, len(docs[i])]))[0] for i in ids])


def _cut(z: np.ndarray, y: np.ndarray) -> float:
    """The logit with the fewest errors when larger ones count as 1; of equal ones, the middle of the widest gap."""
    order = np.argsort(z)
    z, y = z[order], y[order]
    errors = np.concatenate([[0], np.cumsum(y == 1)]) + np.concatenate([np.cumsum((y == 0)[::-1])[::-1], [0]])
    inner = errors[1:-1]
    if not len(inner) or not 0 < y.sum() < len(y):
        return 0.0
    gaps = np.where(inner == errors.min(), np.diff(z), -1.0)
    return float((z[gaps.argmax()] + z[gaps.argmax() + 1]) / 2) if gaps.max() >= 0 else 0.0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lang_col: str = "lang", per_class: int = 3000, longest: int = 1 << 16, **options) -> str:
    """Fit on at most `per_class` labelled documents of either label, chosen by a hash of the id; where the network is stored.

    The ids of the sample (at most 2 * per_class) are broadcast to find their texts, of at most `longest` bytes
    each, so one task can take them. It trains and writes the network to the shared folder, from which
    the tasks that score read it; the driver only receives the path. Rows are put in order of id first, so a
    task that is run again gives the same. Labels other than 0 and 1 and null ids are left out; an id with
    both labels counts as 1, one with several texts gives the least. Null texts are empty, longer ones than
    `longest` aren't learned from (they are scored whole). Without labels every score is below 0.5.
    """
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    sample = [known.filter(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for y in (0, 1)]
    wanted = F.broadcast(sample[0].unionByName(sample[1]))
    lang = F.col(lang_col) if lang_col in docs.columns else F.lit(None)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"), lang.cast("string").alias("lang"))
    rows = rows.filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= longest).join(wanted, "_id")
    rows = rows.groupBy("_id", "_y").agg(F.min(F.struct("text", "lang")).alias("_x")).select("_id", "_y", "_x.text", "_x.lang")
    folder = new_path(docs.sparkSession, "toxicity")

    def work(batches):
        if held := list(batches):
            yield pa.RecordBatch.from_arrays([pa.array([_store(_fit_rows(pa.Table.from_batches(held), options), folder)])], ["path"])

    trained = rows.repartition(1).mapInArrow(work, "path string").first()
    return trained.path if trained else _store(fit(pa.array([], pa.string()), np.zeros(0, np.int64), [], **options), folder)


def _store(net: Network, folder: str) -> str:
    """Write a network under a new name, so a task that runs twice leaves a stray file, never a wrong one."""
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    name = f"{uuid.uuid4().hex}.network"
    with store.open_output_stream(f"{base}/{name}") as sink:
        pickle.dump(replace(net, embedding=net.embedding.astype(np.float32), project=None), sink)
    return f"{folder}/{name}"


@cache
def load(path: str) -> Network:
    """The stored network, read once per Python process."""
    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_file(name) as source:
        return pickle.loads(source.read()).freeze()


def _fit_rows(rows: pa.Table, options: dict) -> Network:
    rows = rows.sort_by("_id")
    mixed = pa.array(np.random.default_rng(3).permutation(rows.num_rows))
    texts = pa.concat_arrays(rows["text"].take(mixed).cast(pa.large_string()).chunks)
    return fit(texts, rows["_y"].take(mixed).to_numpy().astype(np.int64), rows["lang"].take(mixed).to_pylist(), **options)


def score(docs: DataFrame, model: str, text_col: str = "text", names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs plus the score (0 to 1) and predicted (1 if score >= 0.5, else 0); only the text counts.

    model is what train() returned; tasks read it. Null and empty texts get the score of a text without words,
    very long ones are scored whole, a chunk of texts or one long text at a time. Repeated rows and ids are scored
    alike. Columns with the added names are replaced, others kept. An empty table gives no rows.
    """
    docs = docs.select(*[c for c in docs.columns if c.lower() not in names])
    at = docs.columns.index(text_col)

    def work(batches):
        for batch in batches:
            s = load(model).scores(batch.column(at).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*batch.schema.names, *names])

    return docs.mapInArrow(work, T.StructType([*docs.schema, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())]))
