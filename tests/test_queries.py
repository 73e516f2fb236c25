"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest
from check import TABLES, rows_of

import __spark_entry__ as entry
from lodestone.catalog import registry

FOLDER = "/root/testdata/sf0.001"
CHECKED = ["transitive_closure", "information_content", "similarity_top_pairs", "shared_terms", "gene_disease_edges", "annotation_edges", "merge_mentions", "match_conditions",
           "rollup_projects", "top_variants", "organizations_for", "neighbours", "rank_collaborators", "flag_source_conflict", "assess_edges", "routes_shared_pathway", "bm25_topk",
           "audit_text", "load_abstracts"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    cur = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, cur.fetchall())


def test_every_query_is_registered_once_and_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 150


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name, read", [("assets_for", {"entity_closure", "entity_trials"}), ("variants_for", {"entity_closure"}),
                                        ("rank_collaborators", {"entity_closure", "entity_papers", "entity_people"})])
def test_a_query_builds_the_tables_it_reads_and_no_others(spark, duck, monkeypatch, name, read):
    monkeypatch.setattr(registry, "_TABLES", {})
    test_query_equals_sql(spark, duck, name)
    assert set(registry.tables(spark, FOLDER)._built) == read
