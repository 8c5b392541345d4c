from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest

from minewright.llm import textnum as tn


@pytest.mark.parametrize("limit", [1, 40, 1 << 20])
def test_words_and_runs(limit):
    rng = np.random.default_rng(6)
    texts = [None, "", "a", " a  b\tc\x0bd ", "é ç", "x" * 90, *("".join(rng.choice(list("ab \né"), int(rng.integers(0, 25)))) for _ in range(300))]
    column = pa.chunked_array([pa.array(texts[:100]), pa.array(texts[:150]).slice(100), pa.array(texts[150:])])
    assert [bytes(c.data) for c in tn.chunks(pa.array(["ÀB", "İx", None]), limit, lower=True)] != [] and b"".join(bytes(c.data) for c in tn.chunks(pa.array(["ÀB", "Ex", None]), limit, lower=True)) == "àbex".encode()
    seen, rows = {}, []
    for chunk in tn.chunks(column, limit):
        w = tn.words(chunk)
        h = tn.span_hashes(tn.prefix_sums(chunk.data, lower=True), w.start, w.end)
        for n in (1, 2, 3):
            grams, first = tn.ngram_hashes(h, w.first, n)
            for i in range(len(chunk)):
                own = re.findall(r"[^\x20\t-\r]+", texts[chunk.first + i] or "")
                want = [(n, *own[k : k + n]) for k in range(len(own) - n + 1)]
                got = grams[first[i] : first[i + 1]].tolist()
                assert len(got) == len(want)
                for x, y in zip(want, got):
                    assert seen.setdefault(x, y) == y
        rows += range(chunk.first, chunk.first + len(chunk))
    assert rows == list(range(len(texts))) and len(set(seen.values())) == len(seen)
