"""The register: lookups, the next number, appending and keyed update."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import save
from ..sources.versioned import Versioned
from .numbering import numbered

#: Columns of the register.
COLUMNS = ("fnol_id", "member_id", "policy_number", "vehicle_reg", "incident_date", "incident_type", "fnol_received_at", "fnol_age_hours", "aging_risk", "adjuster_id", "triage_status", "escalation_flag", "escalation_reason", "triage_json_path", "triage_pdf_path", "doc_links", "registered_at")
DEFAULTS = {"fnol_age_hours": 0.0, "aging_risk": "LOW", "triage_status": "PENDING", "escalation_flag": False}
KINDS = {"fnol_age_hours": "double", "escalation_flag": "boolean"}
PREFIX = "FNOL"


def look_up(register: DataFrame, ids: DataFrame) -> DataFrame:
    """The first row of each asked id (id), trimmed and in any case."""
    key = lambda c: F.upper(F.trim(F.col(c).cast("string")))
    first = register.withColumn("_r", F.row_number().over(Window.partitionBy(key("fnol_id")).orderBy("row_pos"))).filter("_r = 1").drop("_r")
    return ids.join(first, key("id") == key("fnol_id"))


def member_policies(policies: DataFrame, member_ids: DataFrame) -> DataFrame:
    """Each policy of each asked member (id), a row with all the policy's columns, in the register's order; unknown members have no row."""
    key = lambda c: F.upper(F.trim(F.col(c).cast("string")))
    place = F.row_number().over(Window.partitionBy("id").orderBy("row_pos")) - 1
    return member_ids.join(policies, key("id") == key("member_id")).withColumn("place", place)


def look_up_member(policies: DataFrame, member_ids: DataFrame) -> DataFrame:
    """Each asked member (id) with the list of its policies; unknown members have no row."""
    j = member_ids.join(policies, F.upper(F.trim(F.col("id").cast("string"))) == F.upper(F.trim(F.col("member_id").cast("string"))))
    return j.groupBy("id").agg(F.count("*").alias("n_policies"), F.sort_array(F.collect_list(F.struct("row_pos", "policy_number"))).alias("policies"))


def next_number(register: DataFrame, year: int) -> DataFrame:
    """One row: the highest number of well-formed ids of any year, and one, as an id of this year."""
    p = F.split("fnol_id", "-")
    n = F.when((F.size(p) == 3) & (F.element_at(p, 1) == PREFIX), F.element_at(p, 3).try_cast("int"))
    return register.agg((F.coalesce(F.max(n), F.lit(0)) + 1).alias("n")).select(F.format_string(f"{PREFIX}-%d-%04d", F.lit(year), "n").alias("fnol_id"))


def new_rows(claims: DataFrame, registered_at: dt.datetime) -> DataFrame:
    """claims as register rows: columns that they lack get their defaults or null, all of them the register's types."""
    have = set(claims.columns)
    value = lambda c: F.col(c) if c in have else F.lit(registered_at.isoformat()) if c == "registered_at" else F.lit(DEFAULTS.get(c))
    return claims.select(*[value(c).cast(KINDS.get(c, "string")).alias(c) for c in COLUMNS])


def append(register: DataFrame, claims: DataFrame, registered_at: dt.datetime) -> DataFrame:
    """register with a new row for each of claims behind its last, in the order of their fnol_id, with the positions that follow its last
    one by one; its own columns and types only."""
    last = register.agg(F.coalesce(F.max("row_pos"), F.lit(-1)).alias("_last"))
    added = numbered(new_rows(claims, registered_at), ["fnol_id"], "_nth")
    added = added.crossJoin(F.broadcast(last)).withColumn("row_pos", F.col("_last") + F.col("_nth"))  # one row
    kinds = {f.name: f.dataType for f in register.schema.fields}
    return register.unionByName(added.select(*[(F.col(c) if c in added.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()]))


def number_batch(register: DataFrame, claims: DataFrame, year: int, order: list) -> DataFrame:
    """claims with fnol_id: the numbers that follow the register's highest, one by one in the order. An id has four digits at least."""
    p = F.split("fnol_id", "-")
    n = F.when((F.size(p) == 3) & (F.element_at(p, 1) == PREFIX), F.element_at(p, 3).try_cast("int"))
    last = register.agg(F.coalesce(F.max(n), F.lit(0)).cast("long").alias("_last"))
    out = numbered(claims, order, "_nth").crossJoin(F.broadcast(last))  # one row
    return out.select(F.format_string(f"{PREFIX}-%d-%04d", F.lit(year), F.col("_last") + F.col("_nth")).alias("fnol_id"), *claims.columns)


UPDATED = ("triage_status", "escalation_flag", "escalation_reason", "triage_json_path", "triage_pdf_path")


def update(register: DataFrame, changes: DataFrame) -> DataFrame:
    """register with changes (fnol_id and UPDATED) put into the first row of each id, by its exact trimmed text. Changes that
    repeat an id count as one, the greatest by UPDATED; ids that the register lacks change nothing, see update_all."""
    key = F.trim(F.col("fnol_id").cast("string"))
    c = changes.groupBy(key.alias("_k")).agg(F.max(F.struct(*UPDATED)).alias("_c")).select("_k", *[F.col(f"_c.{u}").alias(f"_{u}") for u in UPDATED])
    first = F.row_number().over(Window.partitionBy(key).orderBy("row_pos")) == 1
    j = register.withColumn("_first", first).join(c, (key == F.col("_k")) & F.col("_first"), "left")
    own = {u: F.when(F.col("_k").isNotNull(), F.col(f"_{u}")).otherwise(F.col(u)) for u in UPDATED}
    return j.select(*[own.get(x, F.col(x)).alias(x) for x in register.columns])


def update_all(register: DataFrame, changes: DataFrame) -> DataFrame:
    """update, but changes to an id that the register lacks are an error."""
    lost = unmatched(register, changes).limit(5).collect()
    if lost:
        raise LookupError(f"not in the register: {', '.join(str(r['fnol_id']) for r in lost)}")
    return update(register, changes)


def unmatched(register: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes whose id the register does not have."""
    return changes.join(register.select("fnol_id"), F.trim(changes["fnol_id"].cast("string")) == F.trim(register["fnol_id"].cast("string")), "left_anti")


def kept_update(table: Versioned, changes: DataFrame, batch: str) -> int:
    """update of a register that stays, keyed by fnol_id: only the buckets of changed ids are read and written. Ids that it lacks are an error."""
    m = table.manifest()
    if m and batch in m["batches"]:
        return m["version"]
    own = changes.withColumn("fnol_id", F.trim(F.col("fnol_id").cast("string")))
    rows = table.read(table.touched(own), m)
    asked = own.select("fnol_id").distinct()
    lost = asked.join(rows.select("fnol_id"), "fnol_id", "left_anti").limit(5).collect()
    if lost:
        raise LookupError(f"not in the register: {', '.join(str(r['fnol_id']) for r in lost)}")
    return table.upsert(update(rows.join(asked, "fnol_id", "left_semi"), own), batch)


def kept_append(table: Versioned, claims: DataFrame, year: int, order: list, registered_at: dt.datetime, batch: str) -> int:
    """claims put into a register that stays, with the numbers and positions that follow its last; those of a batch that is in are not made again."""
    m = table.manifest()
    if m and batch in m["batches"]:
        return m["version"]
    rows = table.read(version=m)
    last = rows.agg(F.coalesce(F.max("row_pos"), F.lit(-1)).alias("_last"))
    ids = save(number_batch(rows, claims, year, order), "register-batch")
    new = append(rows.limit(0), ids, registered_at).crossJoin(F.broadcast(last)).withColumn("row_pos", F.col("row_pos") + F.col("_last") + 1)  # one row
    return table.upsert(new.drop("_last"), batch)


def of_member(records: DataFrame, member: str | None) -> DataFrame:
    """Records that a member may read: those whose own, known member it is, trimmed and in any case. Nobody reads a record without one."""
    asked = (member or "").strip().upper()
    own = F.upper(F.trim(F.col("member_id").cast("string")))
    return records.filter((own == asked) & F.lit(asked != ""))


def visible_to(records: DataFrame, member: str) -> DataFrame:
    """Candidates of a member match, where a blank member matches too; no permission to read: that is of_member."""
    return records.filter(F.coalesce(F.trim(F.col("member_id").cast("string")), F.lit("")).isin("", member))
