"""Queries over what the library has stored: batches, refreshed views, contexts over files, exports, grids of cells."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from linkledger.operators import context, rack, refresh
from linkledger.operators.inventory import KEY, _latest
from linkledger.sources import exports, ledger

from .fixture import Tables, table_dir
from .registry import ACTIVE, BUILD, STATUS3, P, register
from .sheets import EVERY, PER, every


def new_path(t: Tables, kind: str) -> str:
    return f"{table_dir(t.spark)}/{kind}-{uuid.uuid4().hex}"


# Batches: all links but those of a section, then all, then all again.


def _in_batches(t: Tables) -> str:
    path = new_path(t, "link-batches")
    rows = t.links.select(*KEY, "section", "upload_id")
    for batch in (rows.where("section <> 'MACHINERY'"), rows, rows):
        ledger.add_batch(t.spark, path, batch, KEY, by=["a_device"])
    return path


FIRST_BATCH = "AND b1 AS (SELECT a_device, a_port, z_device, z_port, min(struct_pack(section, upload_id)) AS r, 1 AS version FROM links WHERE section <> 'MACHINERY' GROUP BY ALL), b2 AS (SELECT a_device, a_port, z_device, z_port, min(struct_pack(section, upload_id)) AS r, 2 AS version FROM links l WHERE NOT EXISTS (SELECT 1 FROM b1 WHERE b1.a_device = l.a_device AND b1.a_port = l.a_port AND b1.z_device = l.z_device AND b1.z_port = l.z_port) GROUP BY ALL) "
register("batch_commits", lambda t: ledger.commits(t.spark, _in_batches(t)).select("version", "status", "rows"), FIRST_BATCH + "SELECT CAST(1 AS BIGINT) AS version, 'ok' AS status, count(*) AS rows FROM b1 UNION ALL SELECT 2, 'ok', count(*) FROM b2 UNION ALL SELECT 3, 'ok', 0")
register("batch_rows", lambda t: ledger.current(t.spark, _in_batches(t), t.links.select(*KEY, "section", "upload_id").schema), FIRST_BATCH + "SELECT a_device, a_port, z_device, z_port, r.section AS section, r.upload_id AS upload_id, CAST(version AS BIGINT) AS version FROM (FROM b1 UNION ALL FROM b2)")


def _sites(t: Tables):
    """Sites of customers' nations in two loads, the second with names."""
    path = new_path(t, "sites")
    nations = t.read("nation").join(t.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    ledger.upsert_sites(t.spark, path, nations.where("n_nationkey < 12").select(F.col("n_name").alias("site_code"), F.lit("").alias("site_name")))
    out = ledger.upsert_sites(t.spark, path, nations.select(F.col("n_name").alias("site_code"), F.col("r_name").alias("site_name")))
    return out.agg(F.count("*").alias("sites"), F.countDistinct("site_id").alias("numbers")).crossJoin(out.select("site_code", "site_name"))


register("sites_upsert", _sites, "SELECT (SELECT count(DISTINCT n_name) FROM nation) AS sites, (SELECT count(DISTINCT n_name) FROM nation) AS numbers, n_name AS site_code, max(r_name) AS site_name FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_name")


# Views: a refresh over the uploads of all years but the last, then one over all.


def _refreshed(t: Tables, name: str):
    path = new_path(t, "views")
    for uploads in (t.uploads.where("not is_active"), t.uploads):
        refresh.refresh(t.links, uploads, path)
    return refresh.read_view(t.spark, path, name, t.uploads)


register("refresh_optic_inventory_by_side", lambda t: _refreshed(t, "optic_inventory_by_side"), ACTIVE + f" SELECT site_id, optic, side, count(*) AS total, {STATUS3} FROM acte WHERE {P('optic')} GROUP BY 1, 2, 3")
register("refresh_optic_inventory_combined", lambda t: _refreshed(t, "optic_inventory_combined"), ACTIVE + f" SELECT site_id, coalesce({BUILD('a_optic')}, {BUILD('z_optic')}) AS optic, count(*) AS total, {STATUS3} FROM act GROUP BY 1, 2 HAVING optic IS NOT NULL")
register("refresh_cable_status_summary", lambda t: _refreshed(t, "cable_status_summary"), ACTIVE + " SELECT site_id, section, status, status_normalized, count(*) AS cnt FROM act GROUP BY 1, 2, 3, 4")
register("refresh_device_summary", lambda t: _refreshed(t, "device_summary"), ACTIVE + f" SELECT site_id, device, max({BUILD('model')}) AS model, count(*) AS connections, count(DISTINCT port) AS ports FROM acte WHERE {P('device')} GROUP BY 1, 2")


# Context: every upload is a file; they are stored in three loads that overlap, and merged.


def _context(t: Tables) -> str:
    path, rows = new_path(t, "context"), every(t).withColumn("file_hash", F.col("upload_id").cast("string"))
    for load in (F.col("upload_id") % 2 == 0, F.col("upload_id") % 3 > 0, F.lit(True)):
        context.add_files(t.spark, path, rows.where(load), 3)
    return path


CELLS = f", oc AS (SELECT upload_id, a_loc_cab_ru AS location, optic, place, row_idx FROM (SELECT *, a_optic AS optic, 'a_optic' AS place FROM sheet UNION ALL SELECT *, z_optic, 'z_optic' FROM sheet) WHERE {P('a_loc_cab_ru')} AND {P('optic')})"
register("context_counts", lambda t: context.merged_counts(t.spark, _context(t)), EVERY + CELLS + f""" SELECT 'optic' AS kind, optic AS name, location, count(*) AS n, count(*) FILTER (WHERE place = 'a_optic') AS a, count(*) FILTER (WHERE place = 'z_optic') AS z, count(DISTINCT upload_id) AS files FROM oc GROUP BY ALL
UNION ALL SELECT 'model', upper(model), loc, count(*), count(*) FILTER (WHERE side = 'A'), count(*) FILTER (WHERE side = 'Z'), count(DISTINCT upload_id) FROM sends WHERE {P('model')} GROUP BY ALL""")
register("context_evidence", lambda t: context.merged_evidence(t.spark, _context(t), 3).withColumn("rank", F.col("rank").cast("long")), EVERY + CELLS + " SELECT CAST(upload_id AS VARCHAR) AS file_hash, 'optic' AS kind, optic AS name, location, row_idx, place, row_number() OVER (PARTITION BY optic, location ORDER BY CAST(upload_id AS VARCHAR), row_idx, place) AS rank FROM oc QUALIFY rank <= 3")

# Bounded lists.

TOP = EVERY + f", g AS (SELECT upload_id, optic, loc AS loc_cab_ru, count(*) AS n FROM sends WHERE {P('optic')} AND {P('loc')} GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY upload_id, optic ORDER BY n DESC, loc_cab_ru) AS rank FROM g) "
register("every_optic_locations", lambda t: context.optic_locations(every(t), 4, PER).withColumn("rank", F.col("rank").cast("long")), TOP + "SELECT upload_id, optic, loc_cab_ru, n, 1 AS items, rank FROM k WHERE rank <= 4 UNION ALL SELECT upload_id, optic, NULL, CAST(sum(n) AS BIGINT), count(*), 5 FROM k WHERE rank > 4 GROUP BY ALL")
register("every_model_devices", lambda t: context.model_devices(every(t), 5, PER).withColumn("rank", F.col("rank").cast("long")), EVERY + f", g AS (SELECT upload_id, CASE WHEN {P('model')} THEN model ELSE 'UNKNOWN' END AS model, device, min(row_idx || side) AS pos FROM sends WHERE {P('device')} GROUP BY ALL) SELECT upload_id, model, device, row_number() OVER (PARTITION BY upload_id, model ORDER BY pos, device) AS rank, count(*) OVER (PARTITION BY upload_id, model) AS devices FROM g QUALIFY rank <= 5")
PIVOT = ", ".join(f"count(*) FILTER (WHERE status_normalized = '{s}') AS {s}" for s in context.SHOWN)
register("every_status_by_section", lambda t: context.status_by_section(every(t), PER), EVERY + f" SELECT upload_id, section, {PIVOT} FROM sheet WHERE {P('section')} AND {P('status')} GROUP BY 1, 2")
PAIRS = EVERY + f", p AS (SELECT upload_id, a_optic, z_optic, count(*) AS n, min(row_idx) AS row_idx, arg_min(section, row_idx) AS section, arg_min(a_device, row_idx) AS a_device, arg_min(z_device, row_idx) AS z_device FROM sheet WHERE {P('a_optic')} AND {P('z_optic')} AND a_optic <> z_optic GROUP BY 1, 2, 3) "
register("every_optic_pairs", lambda t: context.optic_pairs(every(t), None, PER), PAIRS + "SELECT * FROM p")
register("every_optic_pairs_top", lambda t: context.optic_pairs(every(t), 3, PER), PAIRS + "SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY upload_id ORDER BY n DESC, a_optic, z_optic) <= 3")

# Exports: what the files hold.


def _exported(t: Tables):
    path = new_path(t, "export")
    exports.write_summary(_latest(t), path)
    return t.spark.read.option("header", True).schema("section string, category string, name string, count long").csv(path)


register("export_summary", _exported, "SELECT 'Devices' AS section, 'Device Model' AS category, model AS name, count(DISTINCT device_name) AS count FROM latest WHERE device_name <> '' GROUP BY model UNION ALL SELECT 'Interfaces', type_category, type_label, count(*) FROM latest WHERE device_name <> '' GROUP BY 2, 3")

# Parts as elevation tabs, one for each brand: headers stand in different rows, columns in different places.


def grid(t: Tables):
    n = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int")
    p = t.read("part").select(F.concat(F.lit("ELEV "), "p_brand").alias("tab"), n.alias("n"), "p_partkey", "p_size", "p_name", "p_type")
    swap = F.col("n") % 2 == 0
    body = [(F.when(swap, 0).otherwise(3), F.concat(F.col("p_size").cast("string"), F.lit(".0"))), (F.when(swap, 2).otherwise(1), F.when(F.col("p_partkey") % 9 != 0, F.col("p_name"))), (F.lit(5), F.col("p_type"))]
    head = [(body[0][0], F.lit("ru-base")), (body[1][0], F.lit("DEVICE NAME ")), (body[2][0], F.lit("NETBOX-DEVICE-TYPE"))]
    cells = lambda row, pairs: [F.struct(row.cast("long").alias("row"), c.alias("col"), v.alias("value")) for c, v in pairs]
    below = p.select("tab", F.inline(F.array(*cells(F.col("p_partkey") + 100, body))))
    above = p.select("tab", "n").distinct().select("tab", F.inline(F.array(*cells(F.col("n") % 5 + 1, head), *cells(F.lit(0), [(F.lit(0), F.lit("rack plan"))]))))
    return below.unionByName(above).where("value is not null")


register("elevation_tabs", lambda t: rack.elevations(grid(t)), "SELECT p_brand AS cab_type, p_partkey + 100 AS row, CAST(p_size AS VARCHAR) AS ru, CASE WHEN p_partkey % 9 <> 0 THEN p_name ELSE '' END AS device_name, p_type AS device_type FROM part")
