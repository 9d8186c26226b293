"""The registered corpus queries: contracts, and DuckDB where SQL can express them."""

import duckdb
import pytest
from larkspur.llm.oracles import ORACLES
from larkspur.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
CONTRACT = {
    "op1": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op2": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op3": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op6": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op8": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op9": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op10": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
}


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, DATA)
    kinds = {f.name: f.dataType.simpleString() for f in got.schema.fields}
    assert CONTRACT.get(name.split("_")[0], {}).items() <= kinds.items()
    rows = got.collect()
    assert rows
    if name in ORACLES:
        duck = duckdb.connect()
        for t in ("documents", "pages", "benchmark", "conversations"):
            duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
        want = duck.sql(ORACLES[name])
        names = sorted(got.columns)
        assert names == sorted(want.columns)
        plain = lambda r: repr(tuple(r[n] for n in names))
        assert sorted(map(plain, (r.asDict() for r in rows))) == sorted(plain(dict(zip(want.columns, r, strict=True))) for r in want.fetchall())


def test_language_model_beats_its_base(spark):
    """On held-out texts that are not copies of training texts, on average."""
    rows = [r for r in QUERIES["op3_katz_backoff"](spark, DATA).collect() if r.held_out]
    assert rows and sum(r.score for r in rows) > sum(r.base_score for r in rows)
