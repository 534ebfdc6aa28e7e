"""The queries over rendered pages against their SQL, on small tables."""

import duckdb
import pytest

from webextract.plans import rendered

TABLES = {
    "customer": "SELECT i::BIGINT AS c_custkey, 'Customer#' || i AS c_name, (i % 7)::INT AS c_nationkey, 'MACHINERY' AS c_mktsegment FROM range(24) t(i)",
    "part": "SELECT i::BIGINT AS p_partkey, 'red bolt ' || i AS p_name, 'Brand#' || i AS p_brand, 'ECONOMY' AS p_type, (i % 50 + 1)::INT AS p_size FROM range(84) t(i)",
    "orders": "SELECT i::BIGINT AS o_orderkey, (i * 7)::BIGINT AS o_custkey, 'P' AS o_orderstatus, TIMESTAMP '1998-10-03' + INTERVAL (i) DAY AS o_orderdate, '5-LOW' AS o_orderpriority FROM range(40) t(i)",
    "events": "SELECT i::BIGINT AS event_id, 'click' AS event_type FROM range(25) t(i)",
    "conversations": "SELECT (i // 4)::BIGINT AS conv_id, (i % 4)::BIGINT AS turn, CASE i % 4 WHEN 0 THEN CASE i // 4 % 3 WHEN 0 THEN 'system' ELSE 'user' END WHEN 2 THEN 'user' ELSE 'assistant' END AS role, repeat('Été ' || i || ' no', i % 9 + 1) || chr(10) || 'end' AS text FROM range(43) t(i)",
}


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    place, con = tmp_path_factory.mktemp("rendered"), duckdb.connect()
    for name, sql in TABLES.items():
        con.execute(f"COPY ({sql}) TO '{place}/{name}.parquet'")
        con.execute(f"CREATE VIEW {name} AS FROM '{place}/{name}.parquet'")
    return str(place), con


@pytest.mark.parametrize("name", sorted(rendered.queries()))
def test_equals_its_sql(spark, tables, name):
    place, con = tables
    got = rendered.queries()[name](spark, place)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({rendered.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("name", ["rendered_github", "rendered_main_content", "rendered_markdown", "rendered_properties", "rendered_standard"])
def test_a_table_of_one_file_is_extracted_once_by_all_cores(spark, tables, name):
    got = rendered.queries()[name](spark, tables[0])
    assert got.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan


@pytest.mark.parametrize("html, attempts", [("<body><p>a</p></body>", 1), ('<body><div class="my-newsletter-box">b</div><p>a</p></body>', 2)])
def test_a_page_without_partial_clutter_is_attempted_once(monkeypatch, html, attempts):
    from webextract.plans import extract

    calls, plain = [], extract._attempt
    monkeypatch.setattr(extract, "_attempt", lambda *given: calls.append(given) or plain(*given))
    extract.extract_page(html, "", extract.Options(partial_patterns=("newsletter",)))
    assert len(calls) == attempts
