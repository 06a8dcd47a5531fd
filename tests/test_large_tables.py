"""Queries against their SQL on tables in which a fixed limit is passed that the small ones stay below."""

import duckdb
import pytest

from acceptlake.plans import registry, source_queries, streaming_queries

from . import oracle

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture
def grown(tmp_path):
    """The smallest tables, one of them in place of its own."""

    def of(table, sql):
        con = oracle.connect(SF)
        for t in oracle.TABLES:
            if t == table:
                con.execute(f"COPY ({sql}) TO '{tmp_path}/{t}.parquet'")
            else:
                (tmp_path / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
        return str(tmp_path)

    return of


def test_an_archive_of_very_many_entries(spark, grown):
    d = grown("part", "SELECT p.* REPLACE (CAST(p_partkey + 200 * i AS BIGINT) AS p_partkey, 'Brand#1' AS p_brand) FROM part p, range(60) r(i)")
    codes = {r.code for r in QUERIES["archive_inventory_audit"](spark, d).select("code").distinct().collect()}
    assert duckdb.sql(f"SELECT count(*) FROM '{d}/part.parquet'").fetchall()[0][0] > 10_000 and "too_many_entries" in codes
    oracle.compare(spark, oracle.connect(d), QUERIES["archive_inventory_audit"], SQL["archive_inventory_audit"], d)


def test_a_batch_of_a_stream_is_more_than_one_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streaming_queries, "shared_folder", lambda spark, tag: str(tmp_path / tag))
    streaming_queries.shuffled_stream(spark, SF)
    parts = [len(list((tmp_path / "shuffled" / str(k)).glob("part-*"))) for k in range(streaming_queries._PARTS)]
    assert parts == [spark.sparkContext.defaultParallelism] * streaming_queries._PARTS


def test_evidence_is_redacted_by_all_cores(spark, monkeypatch):
    seen = []

    def sink(tables, root, known):
        seen.append({df.rdd.getNumPartitions() for df in tables.values()})
        raise InterruptedError

    monkeypatch.setattr(source_queries.P, "evidence_sink", sink)
    with pytest.raises(InterruptedError):
        source_queries.evidence_sink(spark, SF)
    assert min(seen[0]) >= spark.sparkContext.defaultParallelism
