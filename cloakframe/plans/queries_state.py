"""Queries of the state that runs share: workspaces, column mode over several runs, edits, alias groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.model import FAKE, REPLACE
from cloakframe.operators import columns, detect, edits
from cloakframe.plans import batch, catalog
from cloakframe.plans.queries import RULE_SCHEMA, table
from cloakframe.plans.workspace import Workspace, newest, with_value
from cloakframe.storage import keep, shared_path

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str):
    def add(f):
        QUERIES[name], ORACLE_SQL[name] = f, oracle
        return f

    return add


@query(
    "workspace_list",
    """WITH log AS (SELECT 'w' || o_custkey % 60 AS id, row_number() OVER (PARTITION BY o_custkey % 60 ORDER BY o_orderkey) AS version, o_orderkey AS updated_at, o_orderstatus AS name, o_orderpriority AS source, o_orderkey % 101 AS history_count, o_orderkey % 6 = 0 AS deleted FROM orders)
SELECT id, name, source, updated_at, history_count FROM log QUALIFY version = max(version) OVER (PARTITION BY id) AND NOT deleted""",
)
def workspace_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a log of commits: the last one of each workspace counts, and deleted ones are left out."""
    o = table(spark, sf_dir, "orders")
    log = o.selectExpr("concat('w', o_custkey % 60) workspace", "o_orderkey version", "o_orderkey time", "o_orderstatus name", "o_orderpriority source", "0L created_at", "o_orderkey % 101 history_count", "o_orderkey % 6 = 0 deleted")
    return catalog.listing(log)


_NAMES = "names AS (SELECT c_custkey, c_name, c_custkey % 3 = 0 AS early FROM customer)"


@query("column_mode_two_runs", f"WITH {_NAMES} SELECT count(*) AS cells, count(DISTINCT c_name) AS originals, count(DISTINCT c_name) AS replacements, true AS restored FROM names")
def column_mode_two_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the customers in a first run, all of them in a second one that knows its state: no value stands for two names, and all come back."""
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey + 1 as row", "c_name as name", "c_custkey % 3 = 0 as early")
    rules = spark.createDataFrame([(0, 0, "PersonName", REPLACE, 0, 0, FAKE, True)], RULE_SCHEMA)
    first = columns.desensitize_columns(detect.segments_of_table(c.where("early"), F.col("row"), "a", ["name"]), rules)
    prior, counters = keep(first.state, "state"), keep(first.counters, "counters")
    cells = detect.segments_of_table(c, F.col("row"), "b", ["name"])
    second = columns.desensitize_columns(cells, rules, prior=prior, counters=counters)
    before = first.segments.where("row > 0").select("row", F.col("text").alias("first_value"))
    after = second.segments.where("row > 0").select("row", F.col("text").alias("replaced")).join(before, "row", "left").join(c.select("row", "name"), "row")
    back = after.join(second.state.select(F.col("replaced_text").alias("replaced"), F.col("original_text").alias("back")), "replaced", "left")
    ok = F.coalesce((F.col("back") == F.col("name")) & (F.coalesce("first_value", "replaced") == F.col("replaced")), F.lit(False))
    return back.agg(F.count(F.lit(1)).alias("cells"), F.count_distinct("name").alias("originals"), F.count_distinct("replaced").alias("replacements"), F.bool_and(ok).alias("restored"))


@query(
    "edit_log_in_order",
    """WITH log AS (SELECT o_orderkey AS seq, o_custkey AS f, CASE o_orderkey % 4 WHEN 0 THEN 'ignore' WHEN 1 THEN 'add' END AS action, CASE WHEN o_orderkey % 3 = 0 THEN 'Fuzzy' END AS value,
  CASE WHEN o_orderkey % 5 = 0 THEN 'NAME' ELSE 'name' END || o_orderkey % 3 AS text FROM orders),
alive AS (SELECT i.f, i.text, i.value = 'Fuzzy' AS fuzzy FROM log i WHERE i.action = 'ignore' AND NOT EXISTS (SELECT 1 FROM log a WHERE a.action = 'add' AND a.f = i.f AND a.seq > i.seq
  AND CASE WHEN i.value = 'Fuzzy' THEN lower(a.text) = lower(i.text) ELSE a.text = i.text END))
SELECT seq AS id FROM log e WHERE NOT EXISTS (SELECT 1 FROM alive a WHERE a.f = e.f AND CASE WHEN a.fuzzy THEN lower(a.text) = lower(e.text) ELSE a.text = e.text END)
UNION ALL SELECT -seq FROM log e WHERE action = 'add' AND NOT EXISTS (SELECT 1 FROM alive a WHERE a.f = e.f AND CASE WHEN a.fuzzy THEN lower(a.text) = lower(e.text) ELSE a.text = e.text END)""",
)
def edit_log_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts ignored exactly or whatever their case, and manual items that end an earlier ignore."""
    place = ["0 sheet_index", "0 row", "0 col", "0 start", "4 end", "'PersonName' type"]
    o = table(spark, sf_dir, "orders").selectExpr("*", "concat(case when o_orderkey % 5 = 0 then 'NAME' else 'name' end, o_orderkey % 3) text", "cast(o_custkey as string) file_id")
    items = o.selectExpr("cast(o_orderkey as string) id", "file_id", "text", *place, "'Regex' source", "1.0D confidence")
    log = o.selectExpr("o_orderkey seq", "case o_orderkey % 4 when 0 then 'ignore' when 1 then 'add' end action", "case when o_orderkey % 3 = 0 then 'Fuzzy' end value", "cast(-o_orderkey as string) id", "file_id", "text", *place)
    return edits.active_items(items, log).select(F.col("id").cast("long").alias("id"))


@query("alias_shared_value", "SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 1 AND c_custkey < 40 THEN 'the primary''s' ELSE 'own ' || c_custkey END AS replaced FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT c_custkey, 'the primary''s' FROM customer WHERE c_custkey % 7 = 0 AND c_custkey % 4 = 1 AND c_custkey < 40")
def alias_shared_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that become members of a group take the primary's value, and those without a mapping get one."""
    c = table(spark, sf_dir, "customer")
    old = c.where("c_custkey % 7 <> 0").selectExpr("c_name original_text", "'PersonName' type", "concat('own ', c_custkey) replaced_text", "'Replace' strategy")
    members = [r.c_name for r in c.where("c_custkey % 4 = 1 and c_custkey < 40").select("c_name").collect()]
    new = with_value(old, members, "PersonName", "the primary's", "Replace", members)
    return new.join(c, F.col("original_text") == F.col("c_name")).select(F.col("c_custkey").alias("id"), F.col("replaced_text").alias("replaced"))


@query(
    "records_restored",
    """WITH o AS (SELECT o_orderkey, o_custkey % 5 AS r, 'p' || o_orderkey % 50 AS p, 'o' || o_orderkey AS v FROM orders), kept AS (SELECT * FROM o WHERE r <> 1),
firsts AS (SELECT p, arg_min(v, ((4 - r) * 100000000 + rank)) AS v FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY v) AS rank FROM (SELECT r, p, v FROM kept GROUP BY ALL)) GROUP BY p)
SELECT o_orderkey AS id, '[' || coalesce(f.v, o.p) || ']' AS text FROM o LEFT JOIN firsts f USING (p)""",
)
def records_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five records in a workspace, one of them deleted: what a value stands for is what the newest record that is left says."""
    o = table(spark, sf_dir, "orders")
    rows = o.selectExpr("o_custkey % 5 r", "concat('p', o_orderkey % 50) replaced_text", "concat('o', o_orderkey) original_text", "'PersonName' type", "'Replace' strategy")
    w = Workspace.create(spark, shared_path(spark, "workspaces"), "orders")
    records = [w.add_record(f"f{k}", rows.where(F.col("r") == k).drop("r").groupBy("replaced_text", "original_text", "type", "strategy").agg(F.count(F.lit(1)).alias("occurrences"))) for k in range(5)]
    w.delete_record(records[1])
    texts = detect.segments_of_documents(o.selectExpr("o_orderkey doc_id", "concat('[p', o_orderkey % 50, ']') text"))
    back, _ = w.restore_all(texts)
    return back.select(F.col("file_id").cast("long").alias("id"), "text")


@query("history_of_workspaces", "SELECT o_custkey % 30 AS workspace, o_orderkey AS seq FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey % 30 ORDER BY o_orderkey DESC) <= 100")
def history_of_workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that a workspace shows; the cap is the feature."""
    return newest(table(spark, sf_dir, "orders").selectExpr("o_custkey % 30 workspace", "o_orderkey seq"), ["seq"], ["workspace"])


@query(
    "batch_status",
    """WITH log AS (SELECT o_custkey % 9 AS batch, o_custkey AS f, o_orderkey AS seq, CASE o_orderkey % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'failed' ELSE 'done' END AS status, CASE WHEN o_orderkey % 4 = 1 THEN 'e' || o_orderkey END AS error FROM orders)
SELECT batch::VARCHAR AS batch, f::VARCHAR AS file_id, arg_max(status, seq) AS status, count(*) FILTER (status <> 'open') AS attempts, (max({'s': seq, 'e': error})).e AS error FROM log GROUP BY batch, f""",
)
def batch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a log of attempts: a file is what its last entry says."""
    log = table(spark, sf_dir, "orders").selectExpr("cast(o_custkey % 9 as string) batch", "cast(o_custkey as string) file_id", "o_orderkey seq", "case o_orderkey % 4 when 0 then 'open' when 1 then 'failed' else 'done' end status", "case when o_orderkey % 4 = 1 then concat('e', o_orderkey) end error")
    return batch.status_of(log)
