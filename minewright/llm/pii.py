"""Personal data: labelers vote on candidate spans, expectation-maximisation weighs them and trains a span classifier."""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from minewright.llm.common import Scratch

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
LABELERS = ("grammar", "form", "check", "gazetteer", "context for", "context against", "edges", "digits")
BUCKETS = 2048

# The base grammar of each kind, and word lists.
LOCAL = string.ascii_letters + string.digits + "._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)++")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
DIALLED = re.compile(r"\+[0-9][ ().0-9-]++")
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz io dev app ai co eu de fr es it uk us ca au jp cn ru br mx ar ch at nl be se no dk fi pl pt in kr".split())
PROVIDERS = frozenset("gmail googlemail hotmail outlook yahoo icloud proton protonmail gmx web aol orange free example mail".split())
CALLING_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
TRIGGERS = {
    EMAIL: "mail email e-mail contact write reach kontakt correo courriel contacto schreiben adresse".split(),
    IP: "ip address host server client login from addr adresse dirección serveur rechner".split(),
    CARD: "card visa mastercard amex credit debit pay paid billing karte kreditkarte tarjeta carte paiement zahlung".split(),
    PHONE: "phone tel call mobile cell fax dial telefon teléfono móvil téléphone portable handy anruf llama".split(),
}
AGAINST = "version ver release isbn issn order ref section chapter page figure table id uuid sha commit build license rfc part model serial bestellung pedido commande".split()

MARK = re.compile(r" ?[\[({<] ?(?:at|AT|At|@|arroba|chez) ?[\])}>] ?| (?:at|AT) (?=[A-Za-z0-9-]{1,63} (?:dot|DOT) [A-Za-z])")
SPOKEN_DOMAIN = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:\.| ?[\[({<] ?(?:dot|DOT|\.|punto|punkt|point) ?[\])}>] ?| (?:dot|DOT) )[A-Za-z0-9-]{1,63}){1,8}")
DEFANGED = re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)| dot )[0-9]{1,3}){3}(?![0-9A-Za-z])")
SIX = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
LONG_NUMBER = re.compile(r"(?<![0-9A-Za-z])[0-9](?:[ .\-/]?[0-9]){12,18}(?![0-9A-Za-z])")
LOCAL_NUMBER = re.compile(r"(?<![0-9A-Za-z+])(?:00[ -]?[0-9]{1,3}[ -])?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z])")
WORD = re.compile(r"[^\W\d_]{2,}")
NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    values = [int(c) for c in digits]
    return (sum(values[-1::-2]) + sum(sum(divmod(2 * v, 10)) for v in values[-2::-2])) % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(matches of the base grammar, what has a kind's shape but fails its check), as (kind, start, end) in order of kind and start.

    Leftmost, not overlapping within a kind, and found in one pass per kind: a match's local part is what stands before an `@`, and
    dotted or spaced digits are taken as whole runs, so no run is looked through more than once.
    """
    found, failed = [], []
    end, at = 0, text.find("@")
    while at >= 0:
        local = at - len(text[end:at]) + len(text[end:at].rstrip(LOCAL))
        if local < at and (m := DOMAIN.match(text, at + 1)):
            found.append((EMAIL, local, m.end()))
            end = m.end()
        else:
            end = at  # what stands before can't be part of a later local part
        at = text.find("@", max(end, at + 1))
    for m in DOTTED.finditer(text):
        parts = m.group().split(".")
        start = m.start()
        for i in range(0, len(parts) - 3, 4):
            size = sum(map(len, parts[i : i + 4])) + 3
            (found if all(map(_octet, parts[i : i + 4])) else failed).append((IP, start, start + size))
            start += size + 1
    for m in DIGITS.finditer(text):
        size = m.end() - m.start()
        if size >= 13:
            plain = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(plain) <= 19 and luhn(plain):
                found.append((CARD, *m.span()))
            elif 13 <= len(plain) <= 19:
                failed.append((CARD, *m.span()))
    if "+" in text:
        for m in DIALLED.finditer(text):
            run = m.group().rstrip(" ().-")
            if len(run) >= 4:
                digits = len(NOT_DIGIT.sub("", run))
                (found if 8 <= digits <= 15 else failed).append((PHONE, m.start(), m.start() + len(run)))
    return found, failed


def wide_spans(text: str) -> Iterator[tuple[int, int, int, str]]:
    """Looser forms of the kinds: (kind, start, end, form)."""
    for m in MARK.finditer(text):
        before = text[max(0, m.start() - 64) : m.start()]
        local = before[len(before.rstrip(LOCAL)) :]
        if local and (d := SPOKEN_DOMAIN.match(text, m.end())):
            yield EMAIL, m.start() - len(local), d.end(), "spoken" if m.group().strip().isalpha() else "bracketed"
    for kind, form, pattern in ((IP, "defanged", DEFANGED), (IP, "six", SIX), (CARD, "long", LONG_NUMBER), (PHONE, "local", LOCAL_NUMBER)):
        for m in pattern.finditer(text):
            yield kind, *m.span(), form


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, form): base matches (form `base`), then failed and wider ones that overlap nothing before them."""
    if not any(c in text for c in "0123456789@") and not MARK.search(text):
        return []
    found, failed = base_spans(text)
    out = [(*x, "base") for x in found]
    taken = sorted((a, b) for _, a, b in found)
    starts = [a for a, _ in taken]
    reach = np.maximum.accumulate([b for _, b in taken]) if taken else np.zeros(0, np.int64)
    last: list[tuple[int, int]] = []
    for kind, a, b, form in sorted([(*x, "failed") for x in failed] + list(wide_spans(text)), key=lambda x: (x[1], -x[2])):
        i = int(np.searchsorted(starts, b)) - 1
        if (i < 0 or reach[i] <= a) and (not last or last[-1][1] <= a):
            out.append((kind, a, b, form))
            last.append((a, b))
    return sorted(out)


def votes(text: str, kind: int, a: int, b: int, form: str) -> list[int]:
    """What each of LABELERS says: 1 (personal data), -1 (not), 0 (abstains)."""
    span, before, after = text[a:b], text[max(0, a - 48) : a].lower(), text[b : b + 24].lower()
    digits = NOT_DIGIT.sub("", span)
    near = set(WORD.findall(before)) | set(WORD.findall(after))
    if kind == EMAIL:
        labels = WORD.findall(span.lower())
        check = 1 if labels and span[-1].isalpha() else -1
        listed = 1 if labels and (labels[-1] in TOP_DOMAINS or PROVIDERS & set(labels)) else 0
    elif kind == IP:
        parts = re.findall(r"[0-9]+", span) if form != "six" else []
        check = 1 if form == "six" or all(map(_octet, parts)) else -1
        first = int(parts[0][:9]) if parts else 32
        listed = -1 if first in (0, 127) else 1 if 0 < first < 224 else 0
    elif kind == CARD:
        check = 1 if 13 <= len(digits) <= 19 and luhn(digits) else -1
        listed = 1 if digits[0] in "456" or digits[:2] in ("34", "37", "35", "36", "38", "30") or "51" <= digits[:2] <= "55" or "2221" <= digits[:4] <= "2720" else 0
    else:
        check = 1 if 8 <= len(digits) <= 15 else -1
        code = digits.removeprefix("00")
        listed = 1 if form != "local" and any(code.startswith(c) for c in (code[:1], code[:2]) if c in CALLING_CODES) else 0
    left, right = text[a - 1 : a] if a else " ", text[b : b + 1] or " "
    glued = left.isalnum() or right.isalnum() or left in "_/=#\"'" or right in "_=\""
    steps = {(int(y) - int(x)) % 10 for x, y in zip(digits, digits[1:], strict=False)}
    return [
        1 if form == "base" else -1 if form == "failed" else 0,
        1 if form in ("base", "bracketed", "defanged", "six") or (kind == PHONE and "(" in span) else 0,
        check,
        listed,
        1 if near & set(TRIGGERS[kind]) else 0,
        -1 if set(WORD.findall(before[-24:])) & set(AGAINST) else 0,
        -1 if glued else 0,
        -1 if kind != EMAIL and len(digits) > 3 and len(steps) == 1 else 0,
    ]


def features(text: str, kind: int, a: int, b: int, form: str) -> list[int]:
    """Hashed features of a span: its kind with form, shape, length, neighbours and the words around; none is a vote."""
    span = text[a:b]
    shape = re.sub(r"(.)\1+", r"\1", "".join("9" if c.isdigit() else "a" if c.isalpha() else c for c in span[:64]))
    around = WORD.findall(text[max(0, a - 32) : a].lower())[-2:], WORD.findall(text[b : b + 24].lower())[:1]
    names = ["", form, f"shape {shape}", f"size {(b - a) // 4}", f"digits {sum(c.isdigit() for c in span)}", f"left {text[a - 1 : a] if a else ''}", f"right {text[b : b + 1]}", *(f"before {w}" for w in around[0]), *(f"after {w}" for w in around[1])]
    return sorted({xxhash.xxh32_intdigest(f"{KINDS[kind]} {n}") % BUCKETS for n in names})


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType()), T.StructField("votes", T.IntegerType()), T.StructField("features", T.ArrayType(T.IntegerType()))]))
_ARROW = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("votes", pa.int32()), ("features", pa.list_(pa.int32()))]))


def _code(own: list[int]) -> int:
    return sum((v + 1) * 3**i for i, v in enumerate(own))


def _spans(text: str | None) -> list[dict]:
    text = text or ""
    return [{"kind": k, "start": a, "end": b, "base": form == "base", "votes": _code(votes(text, k, a, b, form)), "features": features(text, k, a, b, form)} for k, a, b, form in candidates(text)]


def find_candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and spans (kind, start, end, base, votes, features), a row per document; texts don't leave the pass that reads them."""

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([_spans(t.as_py()) for t in part.column(1)], _ARROW)], ["id", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(work, T.StructType([rows.schema["id"], T.StructField("spans", SPAN)]))


@dataclass
class Model:
    """prior[kind]; reliability[kind, labeler, truth, vote + 1]; weights of the span classifier."""

    prior: np.ndarray
    reliability: np.ndarray
    weights: np.ndarray

    def posterior(self, kind: int, codes: np.ndarray) -> np.ndarray:
        return _posterior(self.prior[kind], self.reliability[kind], _decoded(codes))

    def scores(self, found: list[list[int]]) -> np.ndarray:
        return np.array([1 / (1 + np.exp(-self.weights[f].sum())) for f in found])


def _decoded(codes: np.ndarray) -> np.ndarray:
    return codes[:, None] // 3 ** np.arange(len(LABELERS)) % 3


def _posterior(prior: float, reliability: np.ndarray, seen: np.ndarray) -> np.ndarray:
    log = np.log(reliability[np.arange(len(LABELERS))[None, :], :, seen]).sum(1) + np.log([1 - prior, prior])
    return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -60, 60)))


def estimate(codes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[float, np.ndarray]:
    """(share of personal data, reliability[labeler, truth, vote + 1]) by expectation-maximisation over vote patterns and their counts.

    Starts from the votes' sum. Each labeler has some imagined votes in which it is right more often than not, so that
    truth and its opposite can't change places and a labeler that never votes stays neutral.
    """
    seen = _decoded(codes)
    p = 1 / (1 + np.exp(-2.0 * (seen - 1).sum(1)))
    imagined = np.array([[8.0, 4.0, 2.0], [2.0, 4.0, 8.0]])
    prior, reliability = 0.5, np.zeros((len(LABELERS), 2, 3))
    for _ in range(rounds):
        weight = np.stack([counts * (1 - p), counts * p], 1)
        for i in range(len(LABELERS)):
            for v in range(3):
                reliability[i, :, v] = imagined[:, v] + weight[seen[:, i] == v].sum(0)
        reliability /= reliability.sum(2, keepdims=True)
        prior = (weight[:, 1].sum() + 1) / (counts.sum() + 2)
        now = _posterior(prior, reliability, seen)
        done, p = np.abs(now - p).max() < 1e-9, now
        if done:
            break
    return prior, reliability


def classifier(found: list[list[int]], truth: np.ndarray, steps: int = 300, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """Logistic regression on hashed features with soft labels, by full-batch descent with adapted step sizes."""
    flat, size = np.array([x for f in found for x in f], np.int64), np.array([len(f) for f in found], np.int64)
    row = np.repeat(np.arange(len(found)), size)
    w, seen = np.zeros(BUCKETS), np.full(BUCKETS, 1e-8)
    for _ in range(steps if len(found) else 0):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[flat], len(found)), -60, 60)))
        g = np.bincount(flat, (p - truth)[row], BUCKETS) / len(found) + decay * w
        seen += g * g
        w -= rate * g / np.sqrt(seen)
    return w


def fit(found: DataFrame, sample: int = 20_000) -> Model:
    """Reliabilities from the votes on all candidates, and the classifier trained on what they say of at most `sample` of them.

    Votes are counted by kind and pattern, of which there are at most 4 * 3^8. The sample is taken by hash, half of it for matches of
    the base grammar and half for others as far as there are so many; it bounds what the driver trains on, whatever the size of the corpus.
    """
    spans = found.select("id", F.explode("spans").alias("x")).select("id", "x.*")
    patterns = spans.groupBy("kind", "votes", "base").agg(F.count("*").alias("n")).collect()
    prior, reliability = np.full(len(KINDS), 0.5), np.full((len(KINDS), len(LABELERS), 2, 3), 1 / 3)
    for kind in range(len(KINDS)):
        if own := sorted((r.votes, r.n) for r in patterns if r.kind == kind):
            prior[kind], reliability[kind] = estimate(np.array([c for c, _ in own]), np.array([n for _, n in own], float))
    model = Model(prior, reliability, np.zeros(BUCKETS))
    total = {b: max(1, sum(r.n for r in patterns if r.base == b)) for b in (False, True)}
    room = {b: max(sample // 2, sample - min(total[not b], sample // 2)) * 0.9 for b in (False, True)}
    h = F.pmod(F.xxhash64("id", "kind", "start", "end"), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("base"), min(1.0, room[True] / total[True])).otherwise(min(1.0, room[False] / total[False]))
    rows = sorted((r.kind, r.votes, tuple(r.features)) for r in spans.filter(h < share).select("kind", "votes", "features").limit(sample).collect())
    truth = np.array([model.posterior(k, np.array([v]))[0] for k, v, _ in rows])
    model.weights = classifier([list(f) for *_, f in rows], truth)
    return model


def _said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def annotate(found: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, spans (all), and scored: kind, start, end, base, score of those kept.

    A base span is kept whatever its score, any other from `least` on.
    """
    kept_kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())]))

    def work(batches):
        for batch in batches:
            out = [[] for _ in range(7)]
            for spans in batch.column(1).to_pylist():
                scores = model.scores([x["features"] for x in spans])
                kept = sorted((x["kind"], x["start"], x["end"], x["base"], float(p)) for x, p in zip(spans, scores, strict=True) if x["base"] or p >= least)
                base = [x[:3] for x in kept if x[3]]
                for k in range(4):
                    out[k].append(sum(x[0] == k for x in base))
                out[4].append(hashlib.sha256(_said(base).encode()).hexdigest())
                out[5].append(_said([x[:3] for x in kept]))
                out[6].append([dict(zip(("kind", "start", "end", "base", "score"), (KINDS[x[0]], *x[1:]), strict=True)) for x in kept])
            types = [pa.int64()] * 4 + [pa.string(), pa.string(), kept_kind]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(out, types, strict=True)]], ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "scored"])

    longs = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
    scored = T._parse_datatype_string("array<struct<kind: string, start: long, end: long, base: boolean, score: double>>")
    schema = T.StructType([found.schema["id"], *longs, T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("scored", scored)])
    return found.mapInArrow(work, schema)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 20_000, least: float = 0.5) -> DataFrame:
    """A row per document: id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans, scored (see annotate()).

    Emails, IP addresses, card and phone numbers. Matches of the base grammar are always kept. Looser forms (written-out or
    bracketed addresses, defanged and version-6 IPs, numbers that fail a check or come without `+`) are candidates too; regular
    expressions, gazetteers and context vote on all candidates, expectation-maximisation over all votes estimates how
    reliable each labeler is, and a span classifier trained on its verdicts decides which of them are added (see fit()).

    Texts are read once and whole, candidates are kept in the shared folder; nothing is joined or shuffled but counts. Offsets are
    code points. Null texts are empty, empty ones have no spans. Null and repeated ids and repeated rows are
    documents of their own. Very long texts: runs are looked through once. An empty table gives no rows. Other columns are
    ignored, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    found = scratch.keep(find_candidates(docs, id_col, text_col), "candidates")
    return scratch.done(annotate(found, fit(found, sample), least).withColumnRenamed("id", id_col))


def redact(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """docs with each kept span of the text replaced by its kind in brackets, as <email>; null texts stay null, all columns are kept."""
    at = docs.columns.index(text_col)

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        spans = _spans(text)
        scores, out, end = model.scores([x["features"] for x in spans]), [], 0
        for x in sorted((x for x, p in zip(spans, scores, strict=True) if x["base"] or p >= least), key=lambda x: (x["start"], -x["end"])):
            if x["start"] >= end:
                out += [text[end : x["start"]], f"<{KINDS[x['kind']]}>"]
            end = max(end, x["end"])
        return "".join([*out, text[end:]])

    def work(batches):
        for batch in batches:
            yield batch.set_column(at, batch.schema.field(at), pa.array([clean(t.as_py()) for t in batch.column(at)], batch.schema.field(at).type))

    return docs.mapInArrow(work, docs.schema)
