"""The registry is consistent, and some queries agree with their checking SQL."""

import duckdb
import pytest

from maskwright.plans import catalog

NAMES = ["entities_by_source", "vault_assignments", "cloaked_conversations", "overlap_resolved", "hex_secret_spans",
         "offered_load_60s", "identical_runs", "audit_sealed", "audit_chain_verify", "canary_hits", "rare_entities", "audit_log_lines"]


def test_registry():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES) and len(catalog.QUERIES) > 60


@pytest.mark.parametrize("name", NAMES)
def test_checking_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "customer", "conversations", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, sf)
    rel = con.sql(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    rows = lambda data, columns: sorted(repr([dict(zip(columns, r))[c] for c in sorted(columns)]) for r in data)
    assert rows(map(tuple, df.collect()), df.columns) == rows(rel.fetchall(), rel.columns)


def test_streams_read_tables_of_one_file_and_of_many(spark, sf, tmp_path):
    whole = catalog.table(spark, sf, "conversations")
    whole.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    for folder in (sf, str(tmp_path)):
        seen = catalog._run_stream(catalog._stream(spark, folder, "conversations").select("conv_id", "turn"), "test")
        assert seen.count() == whole.count() > 0


def test_rule_hits_mind_case_as_their_sql(spark, sf, tmp_path):
    texts = [(0, "Hash 416272 of hash 416273, Regards"), (1, "HASH abcdef, hash ABCDEF, regards.")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/customer.parquet").limit(3).write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    for t in ("documents", "customer"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    rel = con.sql(catalog.ORACLES["rule_hits"])
    got = catalog.QUERIES["rule_hits"](spark, str(tmp_path)).select(*rel.columns).collect()
    assert sorted(map(tuple, got)) == sorted(rel.fetchall())
