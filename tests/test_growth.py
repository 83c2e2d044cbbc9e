"""Plans whose work or memory grew faster than their tables, on small tables of their own, against DuckDB's SQL."""

import duckdb
import pytest

import __spark_entry__ as entry

from sparktally.session import parts_of

from .test_queries import plain

duck = pytest.fixture(lambda: duckdb.connect())


def same(spark, duck, tmp_path, name, **tables):
    """Whether the query gives its SQL's rows on tables made by the SQL given."""
    for t, sql in tables.items():
        duck.execute(f"COPY ({sql}) TO '{tmp_path}/{t}.parquet'")
        duck.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    got, want = entry.QUERIES[name](spark, str(tmp_path)), duck.execute(entry.ORACLES[name]).df()
    return plain(got.toPandas()) == plain(want) and len(want) > 0


def shuffles(df):
    """Exchanges in the plan as it is before it runs."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_span_probing_repeated_turns(spark, duck, tmp_path):
    """Two texts of one turn are two rows; nothing is shuffled."""
    texts = "SELECT 1 AS conv_id, 0 AS turn, 'user' AS role, unnest(['one  two three four five six seven', 'a bb ccc dddd eeeee ffffff ggggggg hhhhhhhh', ' x', '', NULL, 'ünï cødé wörds in a lïne ôf tëxt that goes on and on']) AS text"
    assert same(spark, duck, tmp_path, "q_span_probing", conversations=texts)
    assert shuffles(entry.QUERIES["q_span_probing"](spark, str(tmp_path))) == 0


@pytest.mark.parametrize("name, most", [("q_component_features", 1), ("q_component_edges", 9)])
def test_parts_grow_with_rows(spark, duck, tmp_path, name, most):
    """The table is dealt by shape into as many parts as it has rows for; only joins shuffle again."""
    lines = "SELECT i // 4 AS l_orderkey, i % 4 AS l_linenumber, i * 7 % 50 AS l_partkey, i * 11 % 40 AS l_suppkey, (i % 9)::DOUBLE AS l_quantity FROM range(0, 2000) t(i)"
    assert same(spark, duck, tmp_path, name, lineitem=lines)
    plan = entry.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(l_orderkey" not in plan and "REPARTITION_BY_NUM" in plan and shuffles(entry.QUERIES[name](spark, str(tmp_path))) <= most
    assert parts_of(spark.read.parquet(f"{tmp_path}/lineitem.parquet"), 100) == 20


@pytest.mark.parametrize("name", ["q_ap_101", "q_ap_by_area", "q_category_report", "q_voc_ap_matched", "q_voc_matching"])
def test_contested_truths(spark, duck, tmp_path, name):
    """Boxes that lie close want each other's truths; images are dealt into as many parts as there are rows for, and met once."""
    lines = """SELECT i // 6 AS l_orderkey, i % 6 + 1 AS l_linenumber, i // 12 % 5 + i % 3 AS l_partkey, i // 18 % 4 + i % 2 AS l_suppkey, (8 + i % 4)::DOUBLE AS l_quantity, (1000 + i * 37 % 101)::DOUBLE AS l_extendedprice,
      (i % 11) / 100.0::DOUBLE AS l_discount, (i % 9) / 100.0::DOUBLE AS l_tax, ['A', 'N', 'R'][i // 3 % 3 + 1] AS l_returnflag, ['F', 'O'][i % 2 + 1] AS l_linestatus FROM range(0, 900) t(i)"""
    assert same(spark, duck, tmp_path, name, lineitem=lines)
    plan = entry.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "hashpartitioning(l_orderkey#" in plan and "hashpartitioning(image" not in plan


def test_accepted_crop_meets_images_once(spark, duck, tmp_path):
    """Repeated lines stay; the windows of an image are tried in one pass, without a shuffle of pairs."""
    lines = "SELECT i // 3 AS l_orderkey, i % 3 + 1 AS l_linenumber, i // 2 * 7 % 97 AS l_partkey, i // 2 * 5 % 89 AS l_suppkey, (i % 40 + 1)::DOUBLE AS l_quantity FROM range(0, 900) t(i) UNION ALL SELECT 1, 2, 30, 20, 9.0 FROM range(0, 2)"
    assert same(spark, duck, tmp_path, "q_accepted_crop", lineitem=lines)
    plan = entry.QUERIES["q_accepted_crop"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan and "Generate" not in plan


def test_face_triangles_meet_in_arrays(spark, duck, tmp_path):
    """Small scenes and one of 1,970 triangles, which goes by cells; meshes are dealt once, and pairs of corners and facets aren't shuffled."""
    lines = """SELECT o AS l_orderkey, n AS l_linenumber, (o * 31 + n * 17) % 1000 AS l_partkey, (o * 13 + n * 7) % 500 AS l_suppkey, ((o + n * 5) % 50 + 1)::DOUBLE AS l_quantity FROM range(0, 60) a(o), range(1, 8) b(n)
      UNION ALL SELECT o, n, o * n % 997, (o + n) % 401, (n % 50)::DOUBLE FROM range(100, 110) a(o), range(1, 201) b(n) UNION ALL SELECT 5, 4, 3, 2, NULL"""
    assert same(spark, duck, tmp_path, "q_face_triangles", lineitem=lines)
    (tmp_path / "few").mkdir()
    duck.execute(f"COPY (SELECT * FROM lineitem WHERE l_orderkey < 60) TO '{tmp_path}/few/lineitem.parquet'")
    plan = entry.QUERIES["q_face_triangles"](spark, str(tmp_path / "few"))._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "hashpartitioning(l_orderkey" not in plan and "Generate" not in plan and "ENSURE_REQUIREMENTS" not in plan


def test_label_quota_sample_takes_clouds_together(spark, duck, tmp_path):
    """Clouds of one point, of one label, of few and of all labels; the table is dealt by cloud once, and clouds aren't sent one by one."""
    lines = """SELECT i // 5 AS l_orderkey, i % 5 + 1 AS l_linenumber, i * 37 % 1000 AS l_partkey, i * 13 % 500 AS l_suppkey, (i * 7 % 50 + 1)::DOUBLE AS l_quantity FROM range(0, 1000) t(i) WHERE i // 100 % 3 < 2 OR i % 5 = 2
      UNION ALL SELECT 1000, 3, 5, 6, 7.0 UNION ALL SELECT 2000 + i, 2, 5, 6, 7.0 FROM range(0, 19) t(i) UNION ALL SELECT 1, 2, 900, 1, 50.0"""
    assert same(spark, duck, tmp_path, "q_label_quota_sample", lineitem=lines)
    plan = entry.QUERIES["q_label_quota_sample"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "FlatMapGroups" not in plan and plan.count("Exchange ") == 1
