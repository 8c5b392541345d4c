from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from minewright.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op2_exact_dedup": {"doc_id", "keep_id", "group_size", "kept", "text_sha256"},
    "op3_warc": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
    "op4_language_id": {"doc_id", "held_out", "lang_pred", "score"},
    "op5_suffix_dedup": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
    "op6_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op7_chat_format": {"conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"},
    "op8_sharding": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op9_mixing": {"doc_id", "size", "source_size", "target", "taken"},
    "op10_near_dedup": {"doc_id", "n_shingles", "component_id", "kept"},
    "op11_pii": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
    "op12_prefix_trie": {"conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"},
    "op13_centroids": {"vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"},
}


def plain(rows, names):
    cell = lambda x: "" if x is None or isinstance(x, float) and math.isnan(x) else str(x)
    return sorted(tuple(cell(r[c]) for c in names) for r in rows)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert set(df.columns) >= COLUMNS[name]
    rows = df.collect()
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{Path(SF) / t}.parquet')")
    keys = {"op3_warc": ["page_id"], "op7_chat_format": ["conv_id"], "op12_prefix_trie": ["conv_id", "depth"], "op13_centroids": ["vec_id"]}.get(name, ["doc_id"])
    assert len(rows) == len({tuple(r[k] for k in keys) for r in rows}) >= 20
    if name in queries.ORACLE_SQL:
        found = con.execute(queries.ORACLE_SQL[name])
        names = sorted(d[0] for d in found.description)
        want = [dict(zip((d[0] for d in found.description), r)) for r in found.fetchall()]
        assert names == sorted(df.columns) and plain(rows, names) == plain(want, names)
