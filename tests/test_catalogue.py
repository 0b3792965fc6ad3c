import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
#: All queries of values; of the queries over trees, which take longer, those that share least.
CHECKED = [n for n in sorted(entry.catalogue.oracle_sql()) if not n.startswith(("xpath", "dom", "dtd", "xml"))]
CHECKED += ["xpath_attr_filter_sum", "xpath_position_last", "xpath_any_node", "xpath_nan", "xpath_names", "xpath_node_kinds", "xml_lang_inherit", "xml_roundtrip", "xml_wf_verdict", "xml_external_entities", "xml_write_options", "dtd_content_model", "dtd_violations", "dom_insert", "dom_equal", "dom_violations"]
CHECKED += ["xpath_filter_sets", "xml_subtrees", "xml_entities", "xml_entity_problems", "xml_records", "xml_structs", "dtd_content_long", "dtd_typed_attributes", "dtd_verdicts"]


def rounded(v):
    return round(float(v), 6) if isinstance(v, (float, Decimal)) else v.isoformat()[:19] if hasattr(v, "isoformat") else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", CHECKED)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    frame = entry.queries()[name](spark, SF)
    cols = sorted(frame.columns)
    got = sorted((tuple(rounded(r[c]) for c in cols) for r in frame.collect()), key=repr)
    cur = con.execute(entry.oracle_sql()[name])
    at = [[x[0] for x in cur.description].index(c) for c in cols]
    assert got == sorted((tuple(rounded(r[i]) for i in at) for r in cur.fetchall()), key=repr)


HALVES = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(HALVES), reason="no test tables")
def test_formats_of_halves_match_sql(spark):
    """sf0.001 has no number that ends in a half of the last digit."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{HALVES}/events.parquet'")
    found = entry.queries()["el_formats"](spark, HALVES).select("event_id", "size", "decimal").collect()
    assert sorted(map(tuple, found)) == sorted(con.execute(f"SELECT event_id, size, decimal FROM ({entry.oracle_sql()['el_formats']})").fetchall())


def test_formats_of_large_sizes_match_sql(spark, tmp_path):
    """Sizes above 1,024 M, which events of no test table reach; every 1,024 * n B up to 8 G, thinned, and all around the limit."""
    ids = spark.range(1, 8_000_000, 997).union(spark.range(1_048_000, 1_049_200)).withColumnRenamed("id", "event_id")
    ids.write.parquet(f"{tmp_path}/events.parquet")
    found = entry.queries()["el_formats"](spark, str(tmp_path)).select("event_id", "size", "decimal").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert sorted(map(tuple, found)) == sorted(con.execute(f"SELECT event_id, size, decimal FROM ({entry.oracle_sql()['el_formats']})").fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
