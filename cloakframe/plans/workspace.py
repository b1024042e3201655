"""Workspaces: the state that runs share, as tables of a log of commits (see ``catalog``).

Every change is one commit of all tables it touches, so a run that fails or loses against another
writer leaves the last version as it is.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cloakframe.operators import restore
from cloakframe.operators.desensitize import MAPPING, number_in_bucket
from cloakframe.plans.catalog import Log, Snapshot, commits, listing
from cloakframe.storage import remove

HISTORY_CAP = 100
TABLES = {
    "mappings": MAPPING,
    "counters": "bucket string, n long",
    "aliases": "member string, primary string, type string, pos int",
    "whitelist": "text string, match_mode string",
    "dictionary": "entry_idx int, text string, type string, match_mode string, replacement string, language string",
    "history": "record_id string, seq long, file_name string, processed_at timestamp, sensitive_count long, status string",
    "attempts": "batch string, file_id string, seq long, status string, error string",
    "record_mappings": "record_id string, idx long, original_text string, replaced_text string, type string, strategy string, occurrences long",
}


def columns_of(table: str) -> list[str]:
    return [x.split()[0] for x in TABLES[table].split(", ")]


def newest(records: DataFrame, order: list[str], by: list[str] | tuple = (), cap: int = HISTORY_CAP) -> DataFrame:
    """The last ``cap`` records by ``order``, in each group of ``by``; the cap is the feature."""
    if not by:
        return records.orderBy(*[F.desc(c) for c in order]).limit(cap)
    w = W.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    return records.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= cap).drop("__r")


def list_workspaces(spark: SparkSession, root: str) -> DataFrame:
    """id, name, source, updated_at and history_count of the workspaces under a folder, the last changed first."""
    return listing(commits(spark, root))


@dataclass
class Workspace:
    """``name`` is the folder; the name that is shown is part of the state and may be changed."""

    spark: SparkSession
    root: str
    name: str

    def __post_init__(self):
        if not re.fullmatch(r"[\w-]+", self.name):
            raise ValueError("a workspace's name has letters, digits, - and _ only")
        self.log = Log(self.spark, self.root, self.name)

    @classmethod
    def create(cls, spark: SparkSession, root: str, name: str, source: str = "File", config: dict | None = None) -> Workspace:
        """A workspace with an id of its own and a name for the user."""
        w = cls(spark, root, uuid.uuid4().hex)
        w.log.commit(Snapshot(), name=name, source=source, config=config or {})
        return w

    def snapshot(self) -> Snapshot:
        s = self.log.snapshot()
        if s.deleted:
            raise ValueError("the workspace is deleted")
        return s

    def rename(self, name: str) -> None:
        self._existing()
        self.log.update(lambda s: ({}, {"name": name}))

    def configure(self, **settings) -> None:
        """Change some settings; the others stay."""
        self.log.update(lambda s: ({}, {"config": {**s.config, **settings}}))

    def delete(self) -> None:
        """The last commit says that the workspace is gone, then its data goes."""
        self._existing()
        self.log.update(lambda s: ({}, {"deleted": True, "tables": {}, "history_count": 0}))
        remove(self.spark, f"{self.log.folder}/data")

    def _existing(self) -> Snapshot:
        s = self.snapshot()
        if not s.version:
            raise ValueError("no such workspace")
        return s

    def read(self, table: str, at: Snapshot | None = None) -> DataFrame:
        """A table of the last version, or of a snapshot; empty if there is none.

        The mappings of records also have ``rec``, 0 for those of the newest record.
        """
        s = at or self.snapshot()
        rows = self.log.read(s, table, TABLES[table])
        if table == "history":
            return newest(rows, ["seq"])
        if table == "record_mappings":
            order = self.read("history", s).select("record_id", (F.row_number().over(W.orderBy(F.desc("seq"))) - 1).alias("rec"))  # HISTORY_CAP rows at most
            return rows.join(F.broadcast(order), "record_id").select("record_id", "rec", *columns_of(table)[1:])
        return rows

    def write(self, table: str, df: DataFrame) -> None:
        self.log.update(lambda s: ({table: ("replace", df.select(*columns_of(table)))}, {}))

    def append(self, table: str, df: DataFrame) -> None:
        self.log.update(lambda s: ({table: ("append", df.select(*columns_of(table)))}, {}))

    def clear_mappings(self, type_key: str | None = None) -> None:
        """Forget all mappings, or those of a type."""

        def change(s: Snapshot):
            old = self.read("mappings", s)
            return {"mappings": ("replace", old.limit(0) if type_key is None else old.where(F.col("type") != type_key))}, {}

        self.log.update(change)

    # ---- records ---------------------------------------------------------------------------

    def record_changes(self, base: Snapshot, record: str, file_name: str, mappings: DataFrame) -> tuple[dict, dict]:
        """What adds a history record with its mappings to a snapshot; the newest HISTORY_CAP records stay."""
        count = mappings.agg(F.sum("occurrences").alias("n")).first()["n"] or 0
        row = self.spark.createDataFrame([(record, base.version + 1, file_name, int(count))], "record_id string, seq long, file_name string, sensitive_count long").select("record_id", "seq", "file_name", F.current_timestamp().alias("processed_at"), "sensitive_count", F.lit("Processed").alias("status"))
        history = newest(row.unionByName(self.read("history", base)), ["seq"])
        return {"history": ("replace", history), "record_mappings": ("append", self._placed(record, mappings))}, {"history_count": min(HISTORY_CAP, base.history_count + 1)}

    def _placed(self, record: str, mappings: DataFrame) -> DataFrame:
        """The place of a mapping in its record is that of the first appearance, where the mappings have one."""
        order = ["place"] if "place" in mappings.columns else ["original_text", "type"]
        placed = number_in_bucket(mappings.withColumn("bucket", F.lit("")), "bucket", order)
        return placed.select(F.lit(record).alias("record_id"), F.col("k").alias("idx"), "original_text", "replaced_text", "type", "strategy", F.col("occurrences").cast("long").alias("occurrences"))

    def add_record(self, file_name: str, mappings: DataFrame) -> str:
        record = uuid.uuid4().hex
        self.log.update(lambda s: self.record_changes(s, record, file_name, mappings))
        return record

    def _record(self, base: Snapshot, record: str) -> None:
        if not self.read("history", base).where(F.col("record_id") == record).limit(1).count():
            raise ValueError("no such record")

    def update_record(self, record: str, mappings: DataFrame) -> None:
        """The mappings of a record replaced, and their number of occurrences with them."""

        def change(s: Snapshot):
            self._record(s, record)
            count = int(mappings.agg(F.sum("occurrences").alias("n")).first()["n"] or 0)
            own = F.col("record_id") == record
            history = self.read("history", s).withColumn("sensitive_count", F.when(own, F.lit(count).cast("long")).otherwise(F.col("sensitive_count")))
            others = self.read("record_mappings", s).where(~own).select(*columns_of("record_mappings"))
            return {"history": ("replace", history), "record_mappings": ("replace", others.unionByName(self._placed(record, mappings)))}, {}

        self.log.update(change)

    def delete_record(self, record: str) -> None:
        """A record and its mappings go; the mappings that later runs share stay."""

        def change(s: Snapshot):
            self._record(s, record)
            rest = {t: ("replace", self.read(t, s).where(F.col("record_id") != record).select(*columns_of(t))) for t in ("history", "record_mappings")}
            return rest, {"history_count": max(0, s.history_count - 1)}

        self.log.update(change)

    def set_status(self, record: str, status: str) -> None:
        def change(s: Snapshot):
            new = F.when(F.col("record_id") == record, status).otherwise(F.col("status"))
            return {"history": ("replace", self.read("history", s).withColumn("status", new))}, {}

        self.log.update(change)

    # ---- names of one entity ---------------------------------------------------------------

    def create_alias_group(self, members: list[str], type_key: str) -> str:
        """A group of two or more names of one entity; its primary is the longest, the later of equals.

        Members that have a mapping get the primary's, if that has one.
        """
        if len(members) < 2:
            raise ValueError("an alias group has two or more members")
        primary = longest(members)

        def change(s: Snapshot):
            if self._taken(s, members, type_key):
                raise ValueError("a member is in another group of this type")
            rows = self.spark.createDataFrame([(m, primary, type_key, k) for k, m in enumerate(members)], TABLES["aliases"])
            return {"aliases": ("append", rows), **self._shared_value(s, primary, members, type_key, [])}, {}

        self.log.update(change)
        return primary

    def add_alias(self, primary: str, member: str, type_key: str) -> str:
        """A further member of a group, whose primary is the longest again; the member gets the primary's mapping."""
        best = primary

        def change(s: Snapshot):
            nonlocal best
            old = self.read("aliases", s)
            own = (F.col("primary") == primary) & (F.col("type") == type_key)
            group = [r.member for r in old.where(own).orderBy("pos").collect()]
            if not group:
                raise ValueError("no such group")
            if self._taken(s, [member], type_key):
                raise ValueError("the member is in a group of this type")
            best = longest([*group, member])
            rows = self.spark.createDataFrame([(m, best, type_key, k) for k, m in enumerate([*group, member])], TABLES["aliases"])
            return {"aliases": ("replace", old.where(~own).unionByName(rows)), **self._shared_value(s, best, [member], type_key, [member])}, {}

        self.log.update(change)
        return best

    def _taken(self, s: Snapshot, members: list[str], type_key: str) -> bool:
        return self.read("aliases", s).where((F.col("type") == type_key) & F.col("member").isin(members)).limit(1).count() > 0

    def _shared_value(self, s: Snapshot, primary: str, members: list[str], type_key: str, added: list[str]) -> dict:
        """The mappings with the primary's value for the members; those of ``added`` that have none get a row."""
        old = self.read("mappings", s)
        value = old.where((F.col("original_text") == primary) & (F.col("type") == type_key)).select("replaced_text", "strategy").first()
        return {"mappings": ("replace", with_value(old, members, type_key, value.replaced_text, value.strategy, added))} if value else {}

    def remove_alias(self, member: str, type_key: str) -> None:
        """Take a member out; a group with one member left goes, and the primary is the longest of those that stay."""

        def change(s: Snapshot):
            rest = self.read("aliases", s).where((F.col("member") != member) | (F.col("type") != type_key))
            groups = rest.groupBy("primary", "type").agg(F.count(F.lit(1)).alias("n"), F.max_by("member", F.struct(F.char_length("member"), "pos")).alias("best")).where("n > 1").drop("n")
            return {"aliases": ("replace", rest.join(groups, ["primary", "type"]).select("member", F.col("best").alias("primary"), "type", "pos"))}, {}

        self.log.update(change)

    def delete_alias_group(self, primary: str, type_key: str) -> None:
        self.log.update(lambda s: ({"aliases": ("replace", self.read("aliases", s).where((F.col("primary") != primary) | (F.col("type") != type_key)))}, {}))

    def alias_groups(self) -> DataFrame:
        """primary, type, members of each group, in the order in which they were given."""
        return self.read("aliases").groupBy("primary", "type").agg(F.array_sort(F.collect_list(F.struct("pos", "member"))).alias("m")).select("primary", "type", F.col("m.member").alias("members"))

    # ---- restoring -------------------------------------------------------------------------

    def restore_record(self, record: str, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(segments, positions) by the mappings of one record, exactly as written; the record is then Restored."""
        self._record(self.snapshot(), record)
        patterns = restore.reverse_mappings(self.read("record_mappings").where(F.col("record_id") == record))
        out = restore.restore(segments, patterns)
        self.set_status(record, "Restored")
        return out

    def restore_all(self, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(segments, positions) by the mappings of all records, the newest first, also where widths of characters changed."""
        patterns = restore.reverse_mappings(self.read("record_mappings"))
        if not patterns.limit(1).count():
            raise ValueError("the workspace has no mapping that can be undone")
        return restore.restore(segments, patterns, fuzzy=True)


def longest(members: list[str]) -> str:
    """The longest, the later of equals."""
    return max(enumerate(members), key=lambda x: (len(x[1]), x[0]))[1]


def with_value(mappings: DataFrame, members: list[str], type_key: str, replaced: str, strategy: str, added: list[str] | tuple = ()) -> DataFrame:
    """Mappings of the members of a group with one value; ``added`` ones without a mapping get a row."""
    own = (F.col("type") == type_key) & F.col("original_text").isin(list(members))
    set_to = {"replaced_text": replaced, "strategy": strategy}
    changed = mappings.withColumns({c: F.when(own, F.lit(v)).otherwise(F.col(c)) for c, v in set_to.items()})
    rows = mappings.sparkSession.createDataFrame([(m, type_key, replaced, strategy) for m in added], MAPPING)
    return changed.unionByName(rows.join(mappings, ["original_text", "type"], "left_anti").select(changed.columns))
