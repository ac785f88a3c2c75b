"""Ingest, counter and rack operators as registered queries: the derived links stand for a sheet's rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkledger.functions import cells
from linkledger.operators import counters, ingest, rack
from linkledger.operators.inventory import _latest
from linkledger.streaming.snapshots import windowed_events

from .fixture import Tables
from .registry import IN_SVC, P, register


def sheet(t: Tables, upload: int | None = 107):
    """One upload (None: every one) as a sheet: in reading order of the id, with locodes."""
    rows = (t.links if upload is None else t.links.where(F.col("upload_id") == upload)).withColumn("row_idx", F.col("id"))
    return rows.withColumns({"a_locode": F.lit("L1"), "z_locode": F.when(F.col("l_linenumber") % 5 == 0, "").otherwise("L2")})


SHEET = "AND sheet AS (SELECT *, id AS row_idx, 'L1' AS a_locode, CASE WHEN l_linenumber % 5 = 0 THEN '' ELSE 'L2' END AS z_locode FROM links WHERE upload_id = 107), sends AS (" + " UNION ALL ".join(
    f"SELECT row_idx, section, status, status_normalized, '{s.upper()}' AS side, {s}_device AS device, {s}_port AS port, {s}_optic AS optic, {s}_model AS model, {s}_loc_cab_ru AS loc, {s}_locode AS locode, {s}_breakout_loc AS breakout FROM sheet" for s in "az"
) + ")"
NAME = "upper(substr(regexp_replace(trim(coalesce(optic, 'nan')), '^[=+\\-@\\s]+', ''), 1, 200))"
FIRST = (
    f", s AS (SELECT *, {NAME} AS name, row_number() OVER (PARTITION BY {{b}}, CASE WHEN {P('breakout')} THEN loc || port END ORDER BY row_idx, side) AS rn FROM sends WHERE {P('locode')}), "
    f"f AS (SELECT * FROM s WHERE length(name) >= 2 AND (({P('breakout')} AND rn = 1) OR (NOT {P('breakout')} AND {P('optic')}))) "
)
register("sheet_optics", lambda t: counters.sheet_optics(sheet(t)), SHEET + FIRST.format(b="1") + "SELECT name AS optic, count(*) AS n FROM f GROUP BY 1")
register("sheet_optics_in_service", lambda t: counters.sheet_optics(sheet(t), "service"), SHEET + FIRST.format(b=f"coalesce({IN_SVC}, false)") + f"SELECT coalesce({IN_SVC}, false) AS in_service, name AS optic, count(*) AS n FROM f GROUP BY 1, 2")
register("sheet_optics_by_status", lambda t: counters.sheet_optics(sheet(t), "status"), SHEET + FIRST.format(b="1") + "SELECT coalesce(nullif(trim(status), ''), 'Unknown') AS shown, name AS optic, count(*) AS n FROM f GROUP BY 1, 2")
register("sheet_optic_cells", lambda t: counters.optic_cells(sheet(t)), SHEET + f" SELECT optic, count(*) FILTER (WHERE side = 'A') AS a, count(*) FILTER (WHERE side = 'Z') AS z, count(*) AS n FROM sends WHERE {P('optic')} GROUP BY 1")
register("sheet_mpo_optics", lambda t: counters.mpo_optics(sheet(t)), SHEET + f", a AS (SELECT optic, count(*) AS a FROM (SELECT DISTINCT a_device, a_port, a_optic AS optic FROM sheet) GROUP BY 1), z AS (SELECT z_optic AS optic, count(*) AS z FROM sheet GROUP BY 1) SELECT optic, coalesce(a, 0) AS a, coalesce(z, 0) AS z, coalesce(a, 0) + coalesce(z, 0) AS n FROM a FULL JOIN z USING (optic) WHERE {P('optic')}")
LOCS = f""", d0 AS (SELECT loc, arg_min(model, side || row_idx) FILTER (WHERE {P('model')}) AS model, bool_or(coalesce({IN_SVC}, false)) AS in_service FROM sends WHERE {P('loc')} GROUP BY loc), d AS (SELECT * FROM d0 WHERE model IS NOT NULL),
cs AS (SELECT loc, CASE WHEN bool_and({P('status')} AND status_normalized = 'lldp_passed') THEN 'Fully Cabled' WHEN bool_and(coalesce(status, '') LIKE 'Cable Not Run%') THEN 'Not Cabled' ELSE 'Work in Progress' END AS state,
  list(coalesce(nullif(nullif(model, ''), 'nan'), 'Unknown') ORDER BY row_idx, side)[1] AS model FROM sends WHERE {P('loc')} GROUP BY loc) """
register("sheet_devices", lambda t: counters.sheet_devices(sheet(t)), SHEET + LOCS + "SELECT model, in_service, count(*) AS n FROM d GROUP BY 1, 2")
register("sheet_cabling_state", lambda t: counters.cabling_state(sheet(t)), SHEET + LOCS + "SELECT state, model, count(*) AS n FROM cs GROUP BY 1, 2")
register("sheet_model_index", lambda t: counters.model_index(sheet(t)), SHEET + f" SELECT upper(model) AS model, count(*) AS n, count(*) FILTER (WHERE side = 'A') AS a, count(*) FILTER (WHERE side = 'Z') AS z, count(DISTINCT loc) AS locations FROM sends WHERE {P('model')} GROUP BY 1")
register("sheet_device_registry", lambda t: counters.device_registry(sheet(t)).select("device", "loc_cab_ru", "model", F.array_join("sections", ",").alias("sections"), F.array_join("sides", ",").alias("sides"), "n"), SHEET + f" SELECT lower(device) AS device, loc AS loc_cab_ru, model, array_to_string(list_sort(list(DISTINCT section)), ',') AS sections, array_to_string(list_sort(list(DISTINCT side)), ',') AS sides, count(*) AS n FROM sends WHERE ({P('device')} OR {P('loc')}) GROUP BY 1, 2, 3")
register("sheet_top_locations", lambda t: counters.top_locations(sheet(t), 3).withColumn("rank", F.col("rank").cast("long")), SHEET + f", g AS (SELECT optic, loc AS loc_cab_ru, count(*) AS n FROM sends WHERE {P('optic')} AND {P('loc')} GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY optic ORDER BY n DESC, loc_cab_ru) AS rank FROM g QUALIFY rank <= 3")
register("roce_optics", lambda t: counters.roce_optics(sheet(t).select(F.col("section").alias("tab"), "row_idx", F.col("a_device").alias("device"), F.col("a_loc_cab_ru").alias("loc"), F.col("a_port").alias("port"), F.col("z_port").alias("connector"), F.col("a_optic").alias("optic")), True), SHEET + ", r AS (SELECT upper(a_optic) AS optic, row_number() OVER (PARTITION BY section, a_loc_cab_ru, substr(a_port, 1, greatest(length(a_port) - 2, 0)), z_port ORDER BY row_idx) AS rn FROM sheet WHERE a_device <> '' AND a_optic NOT IN ('', 'nan')) SELECT optic, count(*) AS n FROM r WHERE rn = 1 GROUP BY 1")
IN_RACK = "(lower(split_part({l}, ':', 1)) = 'dh201' AND split_part({l}, ':', 2) = '41')"
register("rack_links", lambda t: rack.rack_links(sheet(t), "dh201", "041").select("id", "inside"), SHEET + f" SELECT id, {IN_RACK.format(l='a_loc_cab_ru')} AND {IN_RACK.format(l='z_loc_cab_ru')} AS inside FROM sheet WHERE {IN_RACK.format(l='a_loc_cab_ru')} OR {IN_RACK.format(l='z_loc_cab_ru')}")
register("room_optics", lambda t: rack.rack_optics(sheet(t), "dh201", "41"), SHEET + f" SELECT optic, count(*) AS n FROM sends WHERE {IN_RACK.format(l='loc')} AND {P('optic')} GROUP BY 1")
register("rack_devices", lambda t: rack.rack_devices(sheet(t), "dh201", "41", t.hosts), SHEET + f""", o AS (SELECT lower(device) AS device, arg_min(model, side || row_idx) AS model, min(loc) AS loc, count(*) AS cables, bool_and(status_normalized = 'not_run') AS idle FROM sends WHERE {IN_RACK.format(l='loc')} AND {P('device')} GROUP BY 1),
h AS (SELECT lower(hostname) AS device, min(model) AS h_model, min(rack) AS h_loc FROM hosts WHERE {IN_RACK.format(l='rack')} GROUP BY 1)
SELECT device, coalesce(model, h_model) AS model, coalesce(loc, h_loc) AS loc, coalesce(cables, 0) AS cables, CASE WHEN idle THEN 'Pending' WHEN coalesce(cables, 0) > 0 THEN 'Installed' ELSE 'Listed' END AS state FROM o FULL JOIN h USING (device)""")
register("cab_summary", lambda t: rack.cab_summary(sheet(t), t.spark.range(0, 120).select(F.col("id").cast("string").alias("rack"), F.concat(F.lit("type-"), (F.col("id") % 3).cast("string")).alias("cab_type")).where("id % 7 <> 0"), "dh201"), SHEET + ", k AS (SELECT DISTINCT CAST(split_part(loc, ':', 2) AS INTEGER) AS r FROM sends WHERE split_part(loc, ':', 1) = 'dh201') SELECT CASE WHEN r % 7 = 0 THEN 'Unknown' ELSE 'type-' || (r % 3) END AS cab_type, count(*) AS racks FROM k GROUP BY 1")
register("ingest_roles", lambda t: ingest.with_roles(sheet(t), t.hosts).groupBy("a_role", "z_role").agg(F.count("*").alias("n")), SHEET + ", r AS (SELECT upload_id, lower(trim(hostname)) AS h, min(role) AS role FROM hosts GROUP BY 1, 2) SELECT a.role AS a_role, z.role AS z_role, count(*) AS n FROM sheet s LEFT JOIN r a ON s.upload_id = a.upload_id AND lower(trim(a_device)) = a.h LEFT JOIN r z ON s.upload_id = z.upload_id AND lower(trim(z_device)) = z.h GROUP BY 1, 2")


def every(t: Tables):
    return sheet(t, None)


#: The queries above show one sheet. These count every upload as its own sheet, in one job.
PER = ("upload_id",)
EVERY = SHEET.replace(" WHERE upload_id = 107", "").replace("SELECT row_idx,", "SELECT upload_id, row_idx,")
EVERY_FIRST = FIRST.replace("PARTITION BY", "PARTITION BY upload_id,")
register("every_sheet_optics", lambda t: counters.sheet_optics(every(t), per=PER), EVERY + EVERY_FIRST.format(b="1") + "SELECT upload_id, name AS optic, count(*) AS n FROM f GROUP BY 1, 2")
register("every_sheet_optics_in_service", lambda t: counters.sheet_optics(every(t), "service", PER), EVERY + EVERY_FIRST.format(b=f"coalesce({IN_SVC}, false)") + f"SELECT upload_id, coalesce({IN_SVC}, false) AS in_service, name AS optic, count(*) AS n FROM f GROUP BY 1, 2, 3")
register("every_sheet_optics_by_status", lambda t: counters.sheet_optics(every(t), "status", PER), EVERY + EVERY_FIRST.format(b="1") + "SELECT upload_id, coalesce(nullif(trim(status), ''), 'Unknown') AS shown, name AS optic, count(*) AS n FROM f GROUP BY 1, 2, 3")
register("every_sheet_optic_cells", lambda t: counters.optic_cells(every(t), PER), EVERY + f" SELECT upload_id, optic, count(*) FILTER (WHERE side = 'A') AS a, count(*) FILTER (WHERE side = 'Z') AS z, count(*) AS n FROM sends WHERE {P('optic')} GROUP BY 1, 2")
register("every_sheet_mpo_optics", lambda t: counters.mpo_optics(every(t), PER), EVERY + f", a AS (SELECT upload_id, optic, count(*) AS a FROM (SELECT DISTINCT upload_id, a_device, a_port, a_optic AS optic FROM sheet) GROUP BY 1, 2), z AS (SELECT upload_id, z_optic AS optic, count(*) AS z FROM sheet GROUP BY 1, 2) SELECT upload_id, optic, coalesce(a, 0) AS a, coalesce(z, 0) AS z, coalesce(a, 0) + coalesce(z, 0) AS n FROM a FULL JOIN z USING (upload_id, optic) WHERE {P('optic')}")
EVERY_LOCS = LOCS.replace("SELECT loc,", "SELECT upload_id, loc,").replace("GROUP BY loc", "GROUP BY upload_id, loc")
register("every_sheet_devices", lambda t: counters.sheet_devices(every(t), PER), EVERY + EVERY_LOCS + "SELECT upload_id, model, in_service, count(*) AS n FROM d GROUP BY 1, 2, 3")
register("every_sheet_cabling_state", lambda t: counters.cabling_state(every(t), PER), EVERY + EVERY_LOCS + "SELECT upload_id, state, model, count(*) AS n FROM cs GROUP BY 1, 2, 3")


def host_tab(t: Tables):
    """Hosts as the host tabs of all uploads: some are named as the sheets name them, some are in no sheet, some have no model or repeat."""
    n = F.regexp_extract("hostname", r"(\d+)$", 1).cast("int")
    uploads = t.uploads.select("upload_id", "site_id")
    rows = t.hosts.select("site_id", "hostname", "model").withColumn("n", n).join(uploads, "site_id")
    name = F.when(F.col("n") % 3 == 0, F.upper("hostname")).when(F.col("n") % 3 == 1, F.concat(F.lit("spare-"), (F.col("n") % 40).cast("string"))).otherwise(F.col("hostname"))
    status = F.when(F.col("n") % 2 == 0, "Human Verified").when(F.col("n") % 5 == 0, "").otherwise("Cable Not Run")
    rows = rows.select("upload_id", name.alias("hostname"), F.when(F.col("n") % 7 == 0, "nan").otherwise(F.col("model")).alias("model"), status.alias("status"), F.col("n").alias("row_idx"))
    return rows.withColumn("status_normalized", cells.status_slug("status"))


HOST_TAB = f""", ht AS (SELECT u.upload_id, CASE n % 3 WHEN 0 THEN upper(hostname) WHEN 1 THEN 'spare-' || (n % 40) ELSE hostname END AS host, CASE WHEN n % 7 = 0 THEN 'nan' ELSE model END AS model, n % 2 = 0 AS in_service, n
  FROM (SELECT *, CAST(regexp_extract(hostname, '(\\d+)$', 1) AS INTEGER) AS n FROM hosts) h JOIN uploads u USING (site_id)),
un AS (SELECT upload_id, lower(host) AS host, model, in_service FROM ht x WHERE {P('model')} AND NOT EXISTS (SELECT 1 FROM sends s WHERE s.upload_id = x.upload_id AND lower(s.device) = lower(x.host)) QUALIFY row_number() OVER (PARTITION BY upload_id, lower(host) ORDER BY n, model, in_service) = 1) """
register("every_uncabled_hosts", lambda t: counters.uncabled_hosts(every(t), host_tab(t), PER), EVERY + HOST_TAB + "SELECT * FROM un")
register("every_all_devices", lambda t: counters.all_devices(every(t), host_tab(t), PER), EVERY + EVERY_LOCS + HOST_TAB + "SELECT upload_id, upper(model) AS model, in_service, count(*) AS n FROM (SELECT upload_id, model, in_service FROM d UNION ALL SELECT upload_id, model, in_service FROM un) GROUP BY ALL")
register("every_model_locations", lambda t: counters.model_locations(every(t), PER), EVERY + f" SELECT upload_id, upper(model) AS model, loc AS loc_cab_ru, count(*) AS n, count(*) FILTER (WHERE side = 'A') AS a, count(*) FILTER (WHERE side = 'Z') AS z FROM sends WHERE {P('model')} GROUP BY 1, 2, 3")
TABS = {"AUTOMOBILE": "Node to Tier-0 A", "BUILDING": "TIER-0 to TIER-1", "MACHINERY": "backup node to tier-0", "FURNITURE": "Node to Tier-0 B"}


def roce_tabs(t: Tables):
    tab = F.lit("Other")
    for k, v in TABS.items():
        tab = F.when(F.col("section") == k, v).otherwise(tab)
    n = F.col("l_linenumber")
    return every(t).select("upload_id", tab.alias("tab"), "row_idx", "status_normalized", *[c for s in "az" for c in (f"{s}_device", f"{s}_optic", f"{s}_loc_cab_ru")],
        F.concat("a_port", F.when(n % 2 == 0, "s1").otherwise("s2")).alias("a_port"), F.col("z_port"), F.lit("1").alias("a_connector"), F.when(n % 3 == 0, None).otherwise("2").alias("z_connector"))


ROCE_TABS = EVERY.split(", sends AS")[0] + f""", rt AS (SELECT upload_id, CASE section {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in TABS.items())} ELSE 'Other' END AS tab, row_idx, coalesce({IN_SVC}, false) AS in_service, l_linenumber AS n, a_device, a_port || CASE WHEN l_linenumber % 2 = 0 THEN 's1' ELSE 's2' END AS a_port, a_optic, a_loc_cab_ru, z_device, z_port, z_optic, z_loc_cab_ru FROM sheet),
re AS (SELECT upload_id, tab, row_idx, in_service, 'A' AS side, a_device AS device, a_port AS port, a_optic AS optic, a_loc_cab_ru AS loc, '1' AS connector FROM rt UNION ALL SELECT upload_id, tab, row_idx, in_service, 'Z', z_device, z_port, z_optic, z_loc_cab_ru, CASE WHEN n % 3 = 0 THEN 'nan' ELSE '2' END FROM rt),
ro AS (SELECT upload_id, tab, in_service, row_idx, side, optic, loc || CASE WHEN lower(tab) LIKE '%node to tier-0%' THEN port ELSE left(port, -2) END || connector AS place FROM re WHERE {P('device')} AND {P('optic')} AND tab NOT ILIKE '%backup%' AND (tab ILIKE '%node to tier-0%' OR tab ILIKE '%tier-0 to tier-1%')) """
register("roce_tab_optics", lambda t: counters.roce_tab_optics(roce_tabs(t), None, PER), ROCE_TABS + "SELECT upload_id, upper(optic) AS optic, count(*) AS n FROM (SELECT * FROM ro QUALIFY row_number() OVER (PARTITION BY upload_id, tab, place ORDER BY row_idx, side) = 1) GROUP BY ALL")
register("roce_tab_optics_in_service", lambda t: counters.roce_tab_optics(roce_tabs(t), "service", PER), ROCE_TABS + "SELECT upload_id, in_service, upper(optic) AS optic, count(*) AS n FROM (SELECT * FROM ro QUALIFY row_number() OVER (PARTITION BY upload_id, tab, in_service, place ORDER BY row_idx, side) = 1) GROUP BY ALL")
register("every_sheet_model_index", lambda t: counters.model_index(every(t), PER), EVERY + f" SELECT upload_id, upper(model) AS model, count(*) AS n, count(*) FILTER (WHERE side = 'A') AS a, count(*) FILTER (WHERE side = 'Z') AS z, count(DISTINCT loc) AS locations FROM sends WHERE {P('model')} GROUP BY 1, 2")
register("every_sheet_device_registry", lambda t: counters.device_registry(every(t), PER).select("upload_id", "device", "loc_cab_ru", "model", F.array_join("sections", ",").alias("sections"), F.array_join("sides", ",").alias("sides"), "n"), EVERY + f" SELECT upload_id, lower(device) AS device, loc AS loc_cab_ru, model, array_to_string(list_sort(list(DISTINCT section)), ',') AS sections, array_to_string(list_sort(list(DISTINCT side)), ',') AS sides, count(*) AS n FROM sends WHERE ({P('device')} OR {P('loc')}) GROUP BY 1, 2, 3, 4")
LINK_FLAGS = f"a_breakout_loc NOT IN ('', 'nan') AS a_breakout, z_breakout_loc NOT IN ('', 'nan') AS z_breakout, row_number() OVER (PARTITION BY upload_id, a_loc_cab_ru, a_port, {P('a_breakout_loc')} ORDER BY row_idx) = 1 OR NOT {P('a_breakout_loc')} AS a_breakout_new_optic"
register("every_link_records", lambda t: counters.link_records(every(t), PER).select("upload_id", "id", "a_breakout", "z_breakout", "a_breakout_new_optic"), EVERY + f" SELECT upload_id, id, {LINK_FLAGS} FROM sheet")
register("every_sheet_top_locations", lambda t: counters.top_locations(every(t), 3, PER).withColumn("rank", F.col("rank").cast("long")), EVERY + f", g AS (SELECT upload_id, optic, loc AS loc_cab_ru, count(*) AS n FROM sends WHERE {P('optic')} AND {P('loc')} GROUP BY 1, 2, 3) SELECT *, row_number() OVER (PARTITION BY upload_id, optic ORDER BY n DESC, loc_cab_ru) AS rank FROM g QUALIFY rank <= 3")
register("every_roce_optics", lambda t: counters.roce_optics(every(t).select("upload_id", F.col("section").alias("tab"), "row_idx", F.col("a_device").alias("device"), F.col("a_loc_cab_ru").alias("loc"), F.col("a_port").alias("port"), F.col("z_port").alias("connector"), F.col("a_optic").alias("optic")), True, PER), EVERY + ", r AS (SELECT upload_id, upper(a_optic) AS optic, row_number() OVER (PARTITION BY upload_id, section, a_loc_cab_ru, substr(a_port, 1, greatest(length(a_port) - 2, 0)), z_port ORDER BY row_idx) AS rn FROM sheet WHERE a_device <> '' AND a_optic NOT IN ('', 'nan')) SELECT upload_id, optic, count(*) AS n FROM r WHERE rn = 1 GROUP BY 1, 2")
register("every_rack_links", lambda t: rack.rack_links(every(t), "dh201", "041").select("upload_id", "id", "inside"), EVERY + f" SELECT upload_id, id, {IN_RACK.format(l='a_loc_cab_ru')} AND {IN_RACK.format(l='z_loc_cab_ru')} AS inside FROM sheet WHERE {IN_RACK.format(l='a_loc_cab_ru')} OR {IN_RACK.format(l='z_loc_cab_ru')}")
register("every_room_optics", lambda t: rack.rack_optics(every(t), "dh201", "41", PER), EVERY + f" SELECT upload_id, optic, count(*) AS n FROM sends WHERE {IN_RACK.format(l='loc')} AND {P('optic')} GROUP BY 1, 2")
register("every_rack_devices", lambda t: rack.rack_devices(every(t), "dh201", "41", t.hosts, PER), EVERY + f""", o AS (SELECT upload_id, lower(device) AS device, arg_min(model, side || row_idx) AS model, min(loc) AS loc, count(*) AS cables, bool_and(status_normalized = 'not_run') AS idle FROM sends WHERE {IN_RACK.format(l='loc')} AND {P('device')} GROUP BY 1, 2),
h AS (SELECT upload_id, lower(hostname) AS device, min(model) AS h_model, min(rack) AS h_loc FROM hosts WHERE {IN_RACK.format(l='rack')} GROUP BY 1, 2)
SELECT upload_id, device, coalesce(model, h_model) AS model, coalesce(loc, h_loc) AS loc, coalesce(cables, 0) AS cables, CASE WHEN idle THEN 'Pending' WHEN coalesce(cables, 0) > 0 THEN 'Installed' ELSE 'Listed' END AS state FROM o FULL JOIN h USING (upload_id, device)""")
register("every_cab_summary", lambda t: rack.cab_summary(every(t), t.spark.range(0, 120).select(F.col("id").cast("string").alias("rack"), F.concat(F.lit("type-"), (F.col("id") % 3).cast("string")).alias("cab_type")).where("id % 7 <> 0"), "dh201", PER), EVERY + ", k AS (SELECT DISTINCT upload_id, CAST(split_part(loc, ':', 2) AS INTEGER) AS r FROM sends WHERE split_part(loc, ':', 1) = 'dh201') SELECT upload_id, CASE WHEN r % 7 = 0 THEN 'Unknown' ELSE 'type-' || (r % 3) END AS cab_type, count(*) AS racks FROM k GROUP BY 1, 2")
register("every_ingest_roles", lambda t: ingest.with_roles(every(t), t.hosts).groupBy("upload_id", "a_role", "z_role").agg(F.count("*").alias("n")), EVERY + ", r AS (SELECT upload_id, lower(trim(hostname)) AS h, min(role) AS role FROM hosts GROUP BY 1, 2) SELECT s.upload_id, a.role AS a_role, z.role AS z_role, count(*) AS n FROM sheet s LEFT JOIN r a ON s.upload_id = a.upload_id AND lower(trim(a_device)) = a.h LEFT JOIN r z ON s.upload_id = z.upload_id AND lower(trim(z_device)) = z.h GROUP BY 1, 2, 3")
CENTS = "CAST(round(l_discount * 100) AS INTEGER)"


def ib_sheet(t: Tables):
    """Every upload as an InfiniBand workbook of four tabs."""
    n, cents = F.col("l_linenumber") % 4, F.round(F.col("l_discount") * 100).cast("int")
    cell = lambda c, k: F.when(cents % k == 0, counters.IB_CELL).otherwise(F.col(c))
    return every(t).select(
        "upload_id", "row_idx", F.when(n == 0, "Core Pull Schedule").when(n == 1, "Node Pull Schedule").when(n == 2, "UFM pull schedule").otherwise("Overhead").alias("tab"),
        F.when(cents == 0, "Complete").when(cents == 1, "").when(cents == 2, " Cable   Not Run ").otherwise(F.col("status")).alias("status"), F.when(n == 0, F.col("a_optic")).alias("optic_type"),
        F.when(cents % 3 != 0, F.col("a_port")).alias("ibp"), F.col("a_device").alias("source"), F.when(cents == 4, "Destination").when(cents == 5, "two words").otherwise(F.col("z_device")).alias("destination"),
        F.array(cell("a_port", 2), cell("z_port", 3)).alias("cells"), "section",
    )


IB = EVERY.split(", sends AS")[0] + f""", ib0 AS (SELECT *, {CENTS} AS cents, CASE {CENTS} WHEN 0 THEN 'Complete' WHEN 1 THEN 'No Status' WHEN 2 THEN 'Cable Not Run' ELSE coalesce(status, 'No Status') END AS shown,
CASE l_linenumber % 4 WHEN 0 THEN 'core' WHEN 1 THEN 'node' WHEN 2 THEN 'ufm' ELSE 'overhead' END AS tab FROM links),
ib AS (SELECT upload_id, shown, a_optic AS optic, 1 AS k FROM ib0 WHERE tab = 'core' AND {P('a_optic')} UNION ALL SELECT upload_id, shown, 'IB Node Optic', 2 FROM ib0 WHERE tab = 'node' AND cents % 3 <> 0 AND {P('a_port')}
UNION ALL SELECT upload_id, shown, 'Twin Port OSFP', 1 FROM ib0 WHERE tab = 'ufm' AND cents % 2 = 0 UNION ALL SELECT upload_id, shown, 'Twin Port OSFP', 1 FROM ib0 WHERE tab = 'ufm' AND cents % 3 = 0),
ibd0 AS (SELECT upload_id, shown, a_device AS device FROM ib0 WHERE tab <> 'overhead' UNION ALL SELECT upload_id, shown, z_device FROM ib0 WHERE tab <> 'overhead' AND cents NOT IN (4, 5)),
ibd AS (SELECT upload_id, device, bool_or(shown = 'Complete') AS in_service, CASE WHEN bool_and(shown = 'Cable Is Ran: Complete') THEN 'Fully Cabled' WHEN bool_and(shown = 'Cable Not Run') THEN 'Not Cabled' ELSE 'Work in Progress' END AS state FROM ibd0 WHERE {P('device')} GROUP BY 1, 2) """
for n, by, key, dkey in (("", None, "", ""), ("_in_service", "service", "shown = 'Complete' AS in_service, ", "in_service, "), ("_by_status", "status", "shown, ", "state, ")):
    register(f"ib_optics{n}", lambda t, by=by: counters.ib_optics(ib_sheet(t), by, PER), IB + f"SELECT upload_id, {key}upper(optic) AS optic, CAST(sum(k) AS BIGINT) AS n FROM ib GROUP BY ALL")
    register(f"ib_devices{n}", lambda t, by=by: counters.ib_devices(ib_sheet(t), by, PER), IB + f"SELECT upload_id, {dkey}count(*) AS n FROM ibd GROUP BY ALL")


def roce_sheet(t: Tables):
    cents = F.round(F.col("l_discount") * 100).cast("int")
    shown = F.when(cents == 1, "").when(cents == 2, "Run: COMPLETE ").when(cents == 4, "No Label & Not Yet Run").otherwise(F.col("status"))
    return every(t).withColumns({"status": shown, "a_model": F.when(cents == 3, "nan").otherwise(F.col("a_model"))})


ROCE = EVERY.split(", sends AS")[0] + f""", ro AS (SELECT *, {CENTS} AS cents, CASE WHEN {CENTS} IN (1) THEN 'Unknown' WHEN {CENTS} = 2 THEN 'Complete' WHEN {CENTS} = 4 THEN 'No Label & Not Yet Run' WHEN status ILIKE '%complete%' THEN 'Complete' ELSE coalesce(status, 'Unknown') END AS shown FROM sheet) """
register("roce_optics_by_status", lambda t: counters.roce_optics(roce_sheet(t).select("upload_id", "status", F.col("section").alias("tab"), "row_idx", F.col("a_device").alias("device"), F.col("a_loc_cab_ru").alias("loc"), F.col("a_port").alias("port"), F.col("z_port").alias("connector"), F.col("a_optic").alias("optic")), True, PER, "status"), ROCE + ", r AS (SELECT upload_id, shown, upper(a_optic) AS optic, row_number() OVER (PARTITION BY upload_id, section, a_loc_cab_ru, substr(a_port, 1, greatest(length(a_port) - 2, 0)), z_port ORDER BY row_idx) AS rn FROM ro WHERE a_device <> '' AND a_optic NOT IN ('', 'nan')) SELECT upload_id, shown, optic, count(*) AS n FROM r WHERE rn = 1 GROUP BY ALL")
register("roce_devices_by_status", lambda t: counters.roce_devices(roce_sheet(t), PER), ROCE + f""", e AS (SELECT upload_id, row_idx, 'A' AS side, shown, a_loc_cab_ru AS loc, CASE WHEN cents = 3 THEN NULL ELSE a_model END AS model FROM ro UNION ALL SELECT upload_id, row_idx, 'Z', shown, z_loc_cab_ru, z_model FROM ro),
l AS (SELECT upload_id, loc, first(model ORDER BY row_idx, side) FILTER (WHERE {P('model')}) AS model, CASE WHEN bool_and(shown = 'Complete') THEN 'Fully Cabled' WHEN bool_and(shown IN ('No Label & Not Yet Run', 'Unknown')) THEN 'Not Cabled' ELSE 'Work in Progress' END AS state FROM e WHERE {P('loc')} GROUP BY 1, 2)
SELECT upload_id, state, upper(coalesce(model, 'Unknown')) AS model, count(*) AS n FROM l GROUP BY ALL""")
register("location_index", lambda t: counters.location_index(every(t), PER), EVERY + f", c AS (SELECT upload_id, row_idx, a_loc_cab_ru AS location, a_optic AS optic FROM sheet UNION ALL SELECT upload_id, row_idx, a_loc_cab_ru, z_optic FROM sheet) SELECT upload_id, location, optic, count(*) AS n, count(DISTINCT row_idx) AS rows, min(row_idx) AS first_row, max(row_idx) AS last_row FROM c WHERE {P('location')} AND {P('optic')} GROUP BY ALL")
register("tab_value_counts", lambda t: counters.value_counts(ib_sheet(t), "optic_type", PER), IB + "SELECT upload_id, a_optic AS value, count(*) AS n FROM ib0 WHERE tab = 'core' AND a_optic IS NOT NULL GROUP BY ALL")
#: Some statuses with their class, and a header, for the rows of the fixture.
CLASSES, HEADERS = {"LLDP Passed": "VERIFIED", "cable not run": "PLANNED"}, ("Human Verified",)
register("status_classes", lambda t: ingest.with_status_class(ib_sheet(t).withColumns({"status": F.when(F.col("ibp").isNull(), "TIER-1 leaf").otherwise(F.col("status")), "a_optic": F.col("optic_type"), "z_optic": F.lit("")}), CLASSES, HEADERS).groupBy("upload_id", "status_class").agg(F.count("*").alias("n")), IB + f"""SELECT upload_id, CASE WHEN cents % 3 = 0 OR a_port IS NULL THEN CASE WHEN tab = 'core' AND {P('a_optic')} THEN 'UNKNOWN' ELSE 'SECTION_HEADER' END WHEN cents = 1 OR (cents NOT IN (0, 2) AND status IS NULL) THEN 'BLANK'
WHEN cents <> 2 AND lower(status) = 'lldp passed' THEN 'VERIFIED' WHEN cents <> 2 AND status = 'Cable Not Run' THEN 'PLANNED' WHEN cents <> 2 AND status = 'Human Verified' THEN 'SECTION_HEADER' ELSE 'UNKNOWN' END AS status_class, count(*) AS n FROM ib0 GROUP BY ALL""")
register("views_stale", lambda t: ingest.views_stale(t.uploads, t.uploads.where("not is_active").select(F.col("created_at").alias("refreshed_at"))), "SELECT (SELECT max(created_at) FROM uploads) > (SELECT max(created_at) FROM uploads WHERE NOT is_active) AS stale")
register("ingest_status_slugs", lambda t: t.raw_links.groupBy("status", cells.status_slug("status").alias("slug"), "status_normalized").agg(F.count("*").alias("n")), "SELECT status, status_normalized AS slug, status_normalized, count(*) AS n FROM raw_links GROUP BY 1, 2, 3")
#: How the sheets of the fixture write some statuses, by the discount in cents.
WRITTEN = {1: " LLDP:  Passed", 2: "cable ran COMPLETE", 3: "NOT_RUN_PRIORITY", 4: "No Label & Not Yet Run", 5: "Cable is ran - not terminated", 6: "nan", 9: "Odd one", 10: "by hand"}
MEANT = {1: "LLDP Passed", 2: "Cable Is Ran Complete", 3: "Cable Not Run", 4: "Cable Not Run", 5: "Cable Is Ran Not Terminated", 6: "", 9: "Odd one", 10: "Human Verified"}


def respelled(t: Tables):
    cents, status = F.round(F.col("l_discount") * 100).cast("int"), F.col("status")
    for k, v in WRITTEN.items():
        status = F.when(cents == k, v).otherwise(status)
    optic = F.when(cents % 2 == 0, F.concat(F.lit(" "), "a_optic")).otherwise("NaN")
    return t.raw_links.select("upload_id", status.alias("status"), optic.alias("a_optic"), F.lower("a_model").alias("a_model"))


def _settled(t: Tables):
    own = ingest.settled(respelled(t), {"brand#11": "B11"}, {"By Hand": "Human Verified"}, {"b11": "Brand Eleven", "brand#22": "Brand Two"})
    return own.groupBy("upload_id", "status", cells.status_slug("status").alias("slug"), "a_optic", "a_model").agg(F.count("*").alias("n"))


PLAIN = f"CASE {CENTS} {' '.join(f"WHEN {k} THEN '{v}'" for k, v in MEANT.items())} ELSE coalesce(CASE lower(status) WHEN 'lldp passed' THEN 'LLDP Passed' WHEN 'cable is ran: complete' THEN 'Cable Is Ran Complete' WHEN 'cable is ran: not terminated' THEN 'Cable Is Ran Not Terminated' ELSE status END, '') END"
register("ingest_settled", _settled, f"""AND p AS (SELECT upload_id, {PLAIN} AS status, CASE WHEN {CENTS} % 2 = 0 THEN a_optic ELSE '' END AS a_optic, CASE a_model WHEN 'Brand#11' THEN 'Brand Eleven' WHEN 'Brand#22' THEN 'Brand Two' ELSE lower(a_model) END AS a_model FROM raw_links)
SELECT upload_id, status, CASE WHEN status IN ('', 'Cable Not Run') THEN 'not_run' WHEN status LIKE 'Cable Is Ran%' THEN CASE WHEN status LIKE '%Not%' THEN 'not_terminated' ELSE 'complete' END WHEN status = 'Odd one' THEN 'other' ELSE lower(replace(status, ' ', '_')) END AS slug, a_optic, a_model, count(*) AS n FROM p GROUP BY ALL""")
register("ingest_first_rows", lambda t: ingest.physical_links(t.raw_links.withColumnRenamed("id", "row_idx")).groupBy("upload_id").agg(F.count("*").alias("n"), F.max("row_idx").alias("last")), "SELECT upload_id, count(*) AS n, max(id) AS last FROM links GROUP BY 1")
register("ingest_insert_new", lambda t: ingest.insert_new(t.links.where("upload_id = 105"), t.links.where("upload_id = 104"), ["a_device", "a_port", "z_device", "z_port"]).select("id"), "SELECT id FROM links n WHERE upload_id = 105 AND NOT EXISTS (SELECT 1 FROM links o WHERE o.upload_id = 104 AND o.a_device = n.a_device AND o.a_port = n.a_port AND o.z_device = n.z_device AND o.z_port = n.z_port)")
register("ingest_row_filter", lambda t: ingest.row_filter(t.links, [("and", "section", "contains", "AUTO"), ("and", "a_port", "eq", "swp2"), ("or", "z_device", "endswith", "-03"), ("and", "nothing", "eq", "x")]).groupBy("section").agg(F.count("*").alias("n")), "SELECT section, count(*) AS n FROM links WHERE (section ILIKE '%AUTO%' AND a_port = 'swp2') OR z_device LIKE '%-03' GROUP BY 1")


def event_sheet(t: Tables):
    """Events as a sheet in which some rows are section headers."""
    n = F.col("event_id")
    header = n % 40 == 7
    return t.read("events").select(
        (n % 3).cast("string").alias("file"), n.alias("row_idx"), F.when(header, F.concat(F.lit("TIER-"), (n % 9).cast("string"))).when(n % 40 == 8, "loose note").otherwise("Cable Not Run").alias("status"),
        F.when(header, "").otherwise("dh1:1:1").alias("a_loc_cab_ru"), F.when(header, "").otherwise("d").alias("a_device"),
    )


register("ingest_sections", lambda t: ingest.with_sections(event_sheet(t)).groupBy("file", "section", "is_header").agg(F.count("*").alias("n")), """AND s AS (SELECT CAST(event_id % 3 AS VARCHAR) AS file, event_id, event_id % 40 = 7 AS is_header, CASE WHEN event_id % 40 = 7 THEN 'TIER-' || (event_id % 9) END AS h FROM events),
f AS (SELECT *, coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY file ORDER BY event_id ROWS UNBOUNDED PRECEDING), 'UNKNOWN') AS section FROM s) SELECT file, section, is_header, count(*) AS n FROM f GROUP BY 1, 2, 3""")
register("interface_names", lambda t: _latest(t).groupBy(cells.enum_name(F.col("type_label")).alias("type_enum"), F.initcap("type_category").alias("label")).agg(F.count("*").alias("n")), "SELECT 'TYPE_' || upper(replace(type_label, '-', '_')) AS type_enum, array_to_string(list_transform(string_split(type_category, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS label, count(*) AS n FROM latest GROUP BY 1, 2")
register("interfaces_unassigned", lambda t: _latest(t).join(_latest(t).where("hall <> ''").select("hall").distinct(), "hall", "left_anti").groupBy("site", "rack").agg(F.count("*").alias("n")), "SELECT site, rack, count(*) AS n FROM latest WHERE hall = '' GROUP BY 1, 2")
register("event_windows", lambda t: windowed_events(t.read("events")), "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
