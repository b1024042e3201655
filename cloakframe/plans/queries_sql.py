"""Queries that go through ``spark.sql`` only, with the library's SQL functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cloakframe.functions.sqlfunctions import register
from cloakframe.operators.rules import rules_for
from cloakframe.plans import queries as q
from cloakframe.plans import sqltext as sql

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, text: str, oracle: str) -> None:
    """text: Spark SQL in which {name} stands for a table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark)
        for table in ("customer", "conversations", "documents", "orders"):
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(f"cloak_{table}")
        return spark.sql(text)

    QUERIES[name], ORACLE_SQL[name] = run, oracle


query("sql_mask_keep", "SELECT c_custkey, mask_keep(c_name, CAST(c_custkey % 12 AS INT), CAST(c_custkey % 7 AS INT)) AS masked FROM cloak_customer", f"SELECT c_custkey, {sql.mask('c_name', '(c_custkey % 12)::INT', '(c_custkey % 7)::INT')} AS masked FROM customer")
for _lang, _rows in (("zh", q.GENERAL_ZH), ("en", q.GENERAL_EN)):
    query(
        f"sql_generalize_{_lang}",
        f"SELECT c_custkey, generalize_{_lang}({q.picked([r[1] for r in _rows])}, {q.picked([r[0] for r in _rows])}) AS out FROM cloak_customer",
        f"SELECT c_custkey, {q.picked([r[2] for r in _rows])} AS out FROM customer",
    )
for _lang in ("zh", "en"):
    _c, _l = sql.detect("src", rules_for(_lang))
    query(
        f"sql_detect_{_lang}",
        f"SELECT id AS doc_id, i.start_pos, i.end_pos, i.match AS text, i.type FROM (SELECT c_custkey AS id, {q._MADE} AS text FROM cloak_customer) s, LATERAL items_{_lang}(s.text) i",
        f"WITH {q._FIX}, {_c} SELECT id AS doc_id, s::INT AS start_pos, e::INT AS end_pos, m AS text, type FROM {_l}",
    )
query(
    "sql_checks",
    "SELECT o_orderkey, is_luhn(concat('4000 00', lpad(CAST(o_orderkey AS STRING), 10, '0'))) AS card, is_ipv4(concat(o_orderkey % 300, '.1.', o_orderkey % 256, '.0')) AS address, normalize_width(concat('（', translate(o_orderstatus, 'FOP', 'ＦＯＰ'), '）')) AS narrow FROM cloak_orders",
    f"SELECT o_orderkey, (SELECT {sql.LUHN} FROM (SELECT list_transform(string_split('400000' || lpad(o_orderkey::VARCHAR, 10, '0'), ''), lambda c: c::INT) AS d)) AS card, o_orderkey % 300 <= 255 AS address, '(' || o_orderstatus || ')' AS narrow FROM orders",
)
query(
    "sql_type_counts",
    "SELECT x.type, count(*) AS n FROM (SELECT detect_en(text) AS spans FROM cloak_documents) s LATERAL VIEW explode_outer(s.spans) e AS x WHERE x IS NOT NULL GROUP BY x.type",
    f"WITH {q.SRC}, {q._EN_CTES} SELECT type, count(*) AS n FROM {q._EN_LAST} GROUP BY type",
)
