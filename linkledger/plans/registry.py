"""Registered queries over the derived tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from linkledger.functions.cells import CABLE_RUN, IN_SERVICE, VERIFICATION
from linkledger.operators import inventory as q

from .fixture import SQL, Tables

QUERIES, ORACLES = {}, {}

P = lambda c: f"({c} IS NOT NULL AND {c} NOT IN ('', 'nan'))"
BUILD = lambda c: f"CASE WHEN {P(c)} THEN {c} END"
LIST = lambda xs: ", ".join(f"'{x}'" for x in xs)
IN_SVC = f"status_normalized IN ({LIST(IN_SERVICE)})"
STATUS3 = (
    f"CAST(count(*) FILTER (WHERE {IN_SVC}) AS BIGINT) AS in_service, CAST(count(*) FILTER (WHERE status_normalized = 'lldp_failed') AS BIGINT) AS failed, "
    "CAST(count(*) FILTER (WHERE status_normalized IN ('not_run', 'not_terminated', 'pending', 'in_progress', 'addition')) AS BIGINT) AS pending"
)
PHYSICAL = (
    f"phys AS (SELECT * FROM {{rows}} WHERE {P('optic')} QUALIFY row_number() OVER (PARTITION BY side, CASE WHEN breakout IS NOT NULL AND breakout <> '' "
    "THEN CAST(upload_id AS VARCHAR) || '|' || coalesce(loc, '') || '|' || coalesce(port, '') ELSE id END ORDER BY id) = 1)"
)
PCT = "CAST(round(100.0 * {a} / nullif({b}, 0), 1) AS DOUBLE)"


def register(name: str, run, sql: str | None) -> None:
    QUERIES[name] = lambda spark, sf_dir: run(Tables(spark, sf_dir))
    if sql:
        ORACLES[name] = SQL + (", " + sql[4:].lstrip() if sql.startswith("AND ") else sql)


def view(name: str, body: str) -> str:
    """Adds a CTE before the final select."""
    return f"AND {name} AS ({body}) "


S1 = "site_id = 1"
register("section_completion", lambda t: q.section_completion(t), f"SELECT section, count(*) AS total, count(*) FILTER (WHERE {IN_SVC}) AS complete, count(*) FILTER (WHERE NOT ({IN_SVC})) AS incomplete, {PCT.format(a=f'count(*) FILTER (WHERE {IN_SVC})', b='count(*)')} AS pct FROM links GROUP BY section")
register("optic_count", lambda t: q.optic_count(t), "AND " + PHYSICAL.format(rows="ends") + f" SELECT optic, count(*) FILTER (WHERE side = 'A') AS a_count, count(*) FILTER (WHERE side = 'Z') AS z_count, count(*) AS total, {STATUS3} FROM phys GROUP BY optic")
register("optic_count_filtered", lambda t: q.optic_count(t, site_id=1, optic="econ", section="auto", location="dh302"), "AND f AS (SELECT * FROM ends WHERE id IN (SELECT id FROM links WHERE site_id = 1 AND section ILIKE '%auto%' AND (a_loc_cab_ru ILIKE 'dh302:%' OR z_loc_cab_ru ILIKE 'dh302:%')) AND optic ILIKE '%econ%'), " + PHYSICAL.format(rows="f") + f" SELECT optic, count(*) FILTER (WHERE side = 'A') AS a_count, count(*) FILTER (WHERE side = 'Z') AS z_count, count(*) AS total, {STATUS3} FROM phys GROUP BY optic")
for side in ("a", "z"):
    register(f"{side}_device_list", lambda t, side=side: q.side_device_list(t, side, site_id=1), f"SELECT {side}_device AS device, count(*) AS connections, count(DISTINCT {side}_port) AS ports, count(*) OVER () AS total_groups FROM links WHERE {S1} AND {P(side + '_device')} GROUP BY 1 ORDER BY connections DESC, device LIMIT 200")
ROLES = "AND hr AS (SELECT upload_id, lower(trim(hostname)) AS h, min(role) AS role FROM hosts WHERE {w} GROUP BY 1, 2), re AS (SELECT role, side, device, model FROM ends e JOIN hr ON e.upload_id = hr.upload_id AND lower(trim(device)) = h WHERE {w2} AND " + P("role") + " AND " + P("device") + ") SELECT role, side, device, mode(nullif(model, '') ORDER BY nullif(model, '')) AS model, count(*) AS connections FROM re GROUP BY role, side, device ORDER BY role, side, device LIMIT 200"
register("role_lookup", lambda t: q.role_lookup(t, site_id=2, role="build", side="A"), ROLES.format(w="site_id = 2", w2="site_id = 2 AND role ILIKE '%build%' AND side = 'A'"))
register("role_lookup_sides", lambda t: q.role_lookup(t, device="0"), ROLES.format(w="true", w2="device ILIKE '%0%'"))
DEVICES = "SELECT device, count(*) AS connections, count(DISTINCT port) AS ports FROM ends WHERE {w} GROUP BY device ORDER BY connections DESC, device {l}"
register("device_list", lambda t: q.device_list(t, upload_id=107), DEVICES.format(w="upload_id = 107 AND " + P("device"), l="LIMIT 200"))
register("device_detail", lambda t: q.device_list(t, device="LEAF-1", limit=None), DEVICES.format(w="device ILIKE '%LEAF-1%'", l=""))
register("node_compute", lambda t: q.node_compute(t), DEVICES.format(w="regexp_matches(device, '(?i)node|compute|gpu|server')", l=""))
register("device_connections", lambda t: q.device_connections(t, "leaf-07", site_id=3), "SELECT section, a_device, a_port, z_device, z_port, status, id FROM links WHERE site_id = 3 AND (a_device ILIKE '%leaf-07%' OR z_device ILIKE '%leaf-07%') ORDER BY section, a_port, id LIMIT 200")
for n, slugs in (("connection_status", VERIFICATION), ("cable_status", CABLE_RUN)):
    register(n, lambda t, slugs=slugs: q.status_of(t, slugs), f"SELECT status_normalized, status, count(*) AS cnt FROM links WHERE status_normalized IN ({LIST(slugs)}) GROUP BY 1, 2")
register("section_summary", lambda t: q.section_summary(t), "SELECT section, count(*) AS connections, count(DISTINCT a_device) AS a_devices, count(DISTINCT z_device) AS z_devices FROM links GROUP BY section")
register("lldp_failures", lambda t: q.lldp_failures(t, site_id=0), "SELECT section, a_device, a_port, z_device, z_port, id FROM links WHERE site_id = 0 AND status_normalized = 'lldp_failed' ORDER BY section, a_device, id LIMIT 100")
register("site_overview", lambda t: q.site_overview(t, site_id=1), f"SELECT count(*) AS connections, count(DISTINCT {BUILD('a_device')}) AS devices, count(DISTINCT section) AS sections FROM links WHERE {S1}")
register("data_hall_summary", lambda t: q.data_hall_summary(t, hall_prefix="DH20"), f"SELECT split_part(a_loc_cab_ru, ':', 1) AS hall, count(*) AS connections, count(DISTINCT a_device) AS devices FROM links WHERE {P('a_loc_cab_ru')} AND split_part(a_loc_cab_ru, ':', 1) ILIKE 'dh20%' GROUP BY 1")
CELLS = ["a_device", "a_port", "a_optic", "z_device", "z_port", "z_optic", "cable_id"]
RAW = "'{' || concat_ws(',', " + ", ".join(f"CASE WHEN {P(c)} THEN '\"{c}\":\"' || {c} || '\"' END" for c in CELLS) + ") || '}'"
register("raw_search", lambda t: q.raw_search(t, '"SWP3"', site_id=1), f"SELECT id, raw_row FROM (SELECT id, {RAW} AS raw_row FROM links WHERE {S1}) WHERE raw_row ILIKE '%\"SWP3\"%' ORDER BY id LIMIT 50")
NAMED = lambda x: f"({P('device')} AND (model ILIKE '%{x}%' OR device ILIKE '%{x}%'))"
HOSTS = lambda x, w="": f"SELECT hostname AS device, model, 0 AS one FROM hosts WHERE (model ILIKE '%{x}%' OR hostname ILIKE '%{x}%'){w}"
MODEL_TOP = "SELECT device, model, CAST(sum(one) AS BIGINT) AS connections, count(*) OVER () AS total_groups FROM ({r}) GROUP BY device, model ORDER BY connections DESC, device, model LIMIT 200"
LINK_ROWS = "SELECT device, model, 1 AS one FROM ends WHERE "
IN_HALL = " AND id IN (SELECT id FROM links WHERE a_loc_cab_ru ILIKE 'dh202:%' OR z_loc_cab_ru ILIKE 'dh202:%')"
register("model_search_list", lambda t: q.model_list(t, "#1"), MODEL_TOP.format(r=LINK_ROWS + NAMED("#1") + " UNION ALL " + HOSTS("#1")))
register("model_search_names", lambda t: q.model_list(t, "leaf-1"), MODEL_TOP.format(r=LINK_ROWS + NAMED("leaf-1") + " UNION ALL " + HOSTS("leaf-1")))
register("model_search_hall", lambda t: q.model_list(t, "2", data_hall="dh202"), MODEL_TOP.format(r=LINK_ROWS + NAMED("2") + IN_HALL + " UNION ALL " + HOSTS("2", " AND rack ILIKE 'dh202:%'")))
register("model_search_location", lambda t: q.model_list(t, "2", location="dh301:9"), MODEL_TOP.format(r=LINK_ROWS + NAMED("2") + " AND regexp_matches(loc, '^dh301:0*9(:|$)')"))
register("model_search_statuses", lambda t: q.model_list(t, "2", statuses=VERIFICATION), MODEL_TOP.format(r=LINK_ROWS + NAMED("2") + f" AND status_normalized IN ({LIST(VERIFICATION)})"))
COUNTS = "count(*) AS link_rows, count(*) FILTER (WHERE side = 'A') AS a_rows, count(*) FILTER (WHERE side = 'Z') AS z_rows"
RAW_COUNT = f"SELECT {COUNTS}, count(DISTINCT device) AS devices FROM ends WHERE "
register("model_search_raw_count", lambda t: q.model_raw_count(t, "m-2", data_hall="dh302"), RAW_COUNT + NAMED("m-2") + " AND loc ILIKE 'dh302:%'")
register("model_search_raw_count_both_ends", lambda t: q.model_raw_count(t, "2"), RAW_COUNT + NAMED("2"))
register("model_search_status_count", lambda t: q.model_status_count(t, "2", IN_SERVICE), f"SELECT count(DISTINCT {BUILD('loc')}) AS locations, count(DISTINCT device) AS names, {COUNTS} FROM ends WHERE {NAMED('2')} AND {IN_SVC}")
UNIQUE = "AND u AS (SELECT device, 'links' AS source FROM ends WHERE {e} UNION SELECT device, 'inventory' FROM ({h}) WHERE {p}) SELECT count(DISTINCT device) AS total_devices, count(DISTINCT device) FILTER (WHERE source = 'links') AS link_devices, count(DISTINCT device) FILTER (WHERE source = 'inventory') AS inventory_devices FROM u"
register("model_search_unique_count", lambda t: q.model_unique_count(t, "#1"), UNIQUE.format(e=NAMED("#1"), h=HOSTS("#1"), p=P("device")))
register("model_search_unique_hall", lambda t: q.model_unique_count(t, "0", data_hall="dh202"), UNIQUE.format(e=NAMED("0") + " AND loc ILIKE 'dh202:%'", h=HOSTS("0", " AND rack ILIKE 'dh202:%'"), p=P("device")))
register("link_status", lambda t: q.link_status(t, site_id=1), f"SELECT a_device, a_port, z_device, z_port, link_status, status, current_neighbor, current_neighbor_port, dct_notes, id FROM burndown WHERE {S1} ORDER BY link_status, a_device, id LIMIT 200")
register("lldp_neighbor_mismatch", lambda t: q.neighbor_mismatch(t, site_id=1), f"SELECT a_device, a_port, z_device, current_neighbor, id FROM burndown WHERE {S1} AND {P('current_neighbor')} AND lower(trim(current_neighbor)) <> lower(trim(z_device)) ORDER BY a_device, a_port, id LIMIT 200")
register("rack_summary", lambda t: q.rack_summary(t, site_id=1), f"""AND k AS (SELECT e.*, split_part(loc, ':', 1) || ':' || lpad(split_part(loc, ':', 2), 3, '0') AS rack, CASE WHEN {P('e.cable_id')} THEN e.cable_id ELSE concat_ws('|', a_device, a_port, z_device, z_port) END AS link FROM ends e JOIN links USING (id) WHERE e.site_id = 1 AND {P('loc')} AND split_part(loc, ':', 2) <> ''),
o AS (SELECT rack, optic, count(*) AS n FROM k WHERE {P('optic')} GROUP BY rack, optic), b AS (SELECT rack, string_agg(optic || ': ' || n, ', ' ORDER BY n DESC, optic) AS breakdown FROM o GROUP BY rack),
r AS (SELECT rack, count(DISTINCT link) AS connections, count(DISTINCT device) AS devices, array_to_string(list_sort(list(DISTINCT model) FILTER (WHERE {P('model')})), ', ') AS models, coalesce(array_to_string(list_sort(list(DISTINCT optic) FILTER (WHERE {P('optic')})), ', '), '') AS optics, count(*) FILTER (WHERE {P('optic')}) AS optic_rows FROM k GROUP BY rack)
SELECT r.*, breakdown, (SELECT count(DISTINCT rack) FROM k) AS total_racks, (SELECT count(DISTINCT link) FROM k) AS site_connections FROM r LEFT JOIN b USING (rack) ORDER BY connections DESC, rack LIMIT 50""")
LOOKUP = f"AND u AS (SELECT device, side, model, loc, 'links' AS source FROM ends WHERE {P('device')} AND [l] UNION ALL SELECT hostname, '', model, rack, 'inventory' FROM hosts WHERE [r]) SELECT device, side, source, mode(nullif(model, '') ORDER BY nullif(model, '')) AS model, count(*) AS connections, min(loc) AS location FROM u GROUP BY device, side, source ORDER BY source, connections DESC, device, side LIMIT 200"
AT = {
    "location_lookup": ("DH201:4", "regexp_matches(lower([c]), '^dh201:0*4(:|$)')"), "location_lookup_hall": ("dh202", "[c] ILIKE 'dh202:%'"), "location_lookup_rack": ("041", "regexp_matches([c], '^[^:]*:0*41(:|$)')"),
    "location_lookup_unit": ("dh201:41:3", "lower([c]) = 'dh201:41:3'"),
}
for n, (where, test) in AT.items():
    register(n, lambda t, where=where: q.location_lookup(t, where), LOOKUP.replace("[l]", test.replace("[c]", "loc")).replace("[r]", test.replace("[c]", "rack")))
DIFF = """AND o AS (SELECT * FROM links WHERE upload_id = 104), n AS (SELECT * FROM links WHERE upload_id = 105),
d AS (SELECT 'removed' AS change, section, a_device, a_port, z_device, z_port, a_optic, z_optic, status, a_model, z_model, cable_id FROM o ANTI JOIN n USING (a_device, a_port, z_device, z_port)
UNION ALL SELECT 'added', section, a_device, a_port, z_device, z_port, a_optic, z_optic, status, a_model, z_model, cable_id FROM n ANTI JOIN o USING (a_device, a_port, z_device, z_port)
UNION ALL SELECT 'status_changed', o.section, o.a_device, o.a_port, o.z_device, o.z_port, o.a_optic, o.z_optic, o.status || ' -> ' || n.status, o.a_model, o.z_model, o.cable_id FROM o JOIN n USING (a_device, a_port, z_device, z_port) WHERE coalesce(o.status, '') <> coalesce(n.status, '')
UNION ALL SELECT 'optic_changed', o.section, o.a_device, o.a_port, o.z_device, o.z_port, o.a_optic || ' -> ' || n.a_optic || ' / ' || o.z_optic || ' -> ' || n.z_optic, NULL, o.status, o.a_model, o.z_model, o.cable_id FROM o JOIN n USING (a_device, a_port, z_device, z_port)
  WHERE coalesce(o.status, '') = coalesce(n.status, '') AND (coalesce(o.a_optic, '') <> coalesce(n.a_optic, '') OR coalesce(o.z_optic, '') <> coalesce(n.z_optic, '')))
"""
register("upload_diff", lambda t: q.upload_diff(t, 104, 105), DIFF + "SELECT change, count(*) AS cnt FROM d GROUP BY change")
register("upload_diff_rows", lambda t: q.upload_diff_rows(t, 104, 105), DIFF + "SELECT * FROM d")
register("upload_list", lambda t: q.upload_list(t, 1), f"SELECT upload_id, filename, created_at, is_active FROM uploads WHERE {S1} ORDER BY created_at DESC LIMIT 50")
register("latest_upload", lambda t: q.latest_upload(t, 1), f"SELECT upload_id, filename FROM uploads WHERE {S1} AND is_active ORDER BY upload_id DESC LIMIT 1")
ACTIVE = "AND act AS (SELECT l.* FROM links l JOIN uploads u USING (upload_id) WHERE is_active), acte AS (SELECT e.* FROM ends e JOIN uploads u USING (upload_id) WHERE is_active)"
register("cross_site_models", lambda t: q.cross_site_models(t), ACTIVE + f", g AS (SELECT coalesce({BUILD('a_model')}, {BUILD('z_model')}) AS model, site_code, count(*) AS cnt FROM act GROUP BY 1, 2) SELECT *, count(*) OVER (PARTITION BY model) AS sites FROM g WHERE model IS NOT NULL")
register("cross_site_optics", lambda t: q.cross_site_optics(t), ACTIVE + ", " + PHYSICAL.format(rows="acte") + f" SELECT optic, r_name AS site_code, count(*) AS total, {STATUS3} FROM phys JOIN region ON r_regionkey = site_id GROUP BY 1, 2")
register("cross_site_status", lambda t: q.cross_site_status(t), ACTIVE + " SELECT site_code, status_normalized, count(*) AS cnt FROM act GROUP BY 1, 2")
SLUG_COLS = ", ".join(f"count(*) FILTER (WHERE status_normalized = '{s}') AS {s}" for s in q.TREND_SLUGS)
TREND = f"count(*) AS total, {SLUG_COLS}, count(*) FILTER (WHERE {IN_SVC}) AS completed FROM uploads u LEFT JOIN links l ON u.upload_id = l.upload_id AND l.site_id = {{s}} WHERE u.site_id = {{s}}"
register("trend_status", lambda t: q.trend_status(t, 1), f"AND g AS (SELECT u.upload_id, u.filename, u.created_at, {TREND.format(s=1)} GROUP BY 1, 2, 3) SELECT *, {PCT.format(a='completed', b='total')} AS pct, 1 AS site_id, completed - lag(completed) OVER (ORDER BY created_at, upload_id) AS delta FROM g ORDER BY created_at LIMIT 10")
TREND_SECTION = f"AND g AS (SELECT u.upload_id, u.filename, u.created_at, section, {TREND} AND {{w}} GROUP BY 1, 2, 3, 4) SELECT *, {PCT.format(a='completed', b='total')} AS pct, completed - lag(completed) OVER (PARTITION BY section ORDER BY created_at, upload_id) AS delta FROM g ORDER BY created_at, section LIMIT 100"
register("trend_section", lambda t: q.trend_section(t, 1, "machin"), TREND_SECTION.format(s=1, w="section ILIKE '%machin%'"))
register("trend_sections", lambda t: q.trend_section(t, 2), TREND_SECTION.format(s=2, w="true"))
COMPOSITE = f"""AND own AS (SELECT * FROM links WHERE site_id = {{s}} AND upload_id = {{u}}), n AS (SELECT 'device' AS part, a_device AS name, status_normalized FROM own UNION ALL SELECT 'device', z_device, status_normalized FROM own UNION ALL SELECT 'status', status, status_normalized FROM own
UNION ALL SELECT 'optic', coalesce(nullif(a_optic, ''), nullif(z_optic, '')), status_normalized FROM own), g AS (SELECT part, name, count(*) AS n, count(*) FILTER (WHERE {IN_SVC}) AS in_service, count(*) FILTER (WHERE status_normalized = 'lldp_failed') AS failed FROM n WHERE part = 'status' OR {P('name')} GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY part ORDER BY n DESC, name NULLS FIRST) AS rank FROM g QUALIFY rank <= CASE part WHEN 'device' THEN 20 WHEN 'optic' THEN 15 ELSE 1e9 END"""
register("composite", lambda t: q.composite(t, 3), COMPOSITE.format(s=3, u="(SELECT max(upload_id) FROM uploads WHERE site_id = 3 AND is_active)"))
register("composite_upload", lambda t: q.composite(t, 2, 203), COMPOSITE.format(s=2, u=203))
register("cable_type_summary", lambda t: q.cable_type_summary(t), f"SELECT cable_type, count(*) AS connections, count(DISTINCT a_device) AS a_devices, count(DISTINCT z_device) AS z_devices FROM links WHERE {P('cable_type')} GROUP BY 1")
register("general", lambda t: q.general(t), f"SELECT 'connections' AS metric, CAST(count(*) AS VARCHAR) AS value FROM links UNION ALL SELECT 'devices', CAST(count(DISTINCT a_device) AS VARCHAR) FROM links WHERE {P('a_device')} UNION ALL SELECT 'sections', CAST(count(DISTINCT section) AS VARCHAR) FROM links")
register("general_devices", lambda t: q.device_list(t, site_id=1, limit=20), DEVICES.format(w=f"{S1} AND " + P("device"), l="LIMIT 20"))
register("general_optics", lambda t: q.general_optics(t), f"SELECT coalesce({BUILD('a_optic')}, {BUILD('z_optic')}) AS optic, count(*) AS cnt FROM links GROUP BY 1 ORDER BY cnt DESC, optic LIMIT 15")
register("view_optic_inventory_by_side", lambda t: q.optic_inventory_by_side(t), ACTIVE + f" SELECT site_id, optic, side, count(*) AS total, {STATUS3} FROM acte WHERE {P('optic')} GROUP BY 1, 2, 3")
register("view_optic_inventory_combined", lambda t: q.optic_inventory_combined(t), ACTIVE + f" SELECT site_id, coalesce({BUILD('a_optic')}, {BUILD('z_optic')}) AS optic, count(*) AS total, {STATUS3} FROM act GROUP BY 1, 2 HAVING optic IS NOT NULL")
register("view_cable_status_summary", lambda t: q.cable_status_summary(t), ACTIVE + " SELECT site_id, section, status, status_normalized, count(*) AS cnt FROM act GROUP BY 1, 2, 3, 4")
register("view_device_summary", lambda t: q.device_summary(t), ACTIVE + f" SELECT site_id, device, max({BUILD('model')}) AS model, count(*) AS connections, count(DISTINCT port) AS ports FROM acte WHERE {P('device')} GROUP BY 1, 2")
register("view_latest_snapshot", lambda t: q.latest_snapshot(t), "SELECT * FROM snapshots WHERE status = 'ok' ORDER BY snapshot_id DESC LIMIT 1")
register("dashboard_summary", lambda t: q.dashboard_summary(t), "SELECT device_status, count(DISTINCT device_name) AS devices, device_status IN ('active', 'provisioned') AS healthy FROM latest WHERE device_name <> '' GROUP BY 1")
register("dashboard_sites", lambda t: q.dashboard_sites(t), "SELECT site, count(DISTINCT device_name) AS devices, count(DISTINCT nullif(trim(hall), '')) AS halls FROM latest WHERE device_name <> '' GROUP BY 1")
OPT = "(type_category ILIKE '%optical%' OR type_category ILIKE '%infiniband%' OR type_category ILIKE '%fibre%')"
HALL = "coalesce(nullif(trim(hall), ''), 'unassigned')"
register("dashboard_halls", lambda t: q.dashboard_halls(t), f"SELECT site, {HALL} AS hall, count(DISTINCT device_name) AS devices, count(*) AS interfaces, count(DISTINCT nullif(rack, '')) AS racks FROM latest WHERE device_name <> '' GROUP BY 1, 2")
register("dashboard_models", lambda t: q.dashboard_models(t), "SELECT model, count(DISTINCT device_name) AS devices FROM latest WHERE device_name <> '' GROUP BY 1 ORDER BY devices DESC, model LIMIT 20")
register("dashboard_hall_models", lambda t: q.dashboard_hall_models(t), "SELECT hall, model, count(DISTINCT device_name) AS devices FROM latest WHERE device_name <> '' GROUP BY 1, 2")
register("dashboard_optics", lambda t: q.dashboard_optics(t), f"SELECT type_label, type_category, count(*) AS ports, {OPT} AS optical FROM latest WHERE device_name <> '' GROUP BY 1, 2 ORDER BY ports DESC, type_label, type_category LIMIT 25")
register("dashboard_utilization", lambda t: q.dashboard_utilization(t), f"AND h AS (SELECT {HALL} AS hall, type_label, {OPT} AS optical FROM latest WHERE device_name <> '') SELECT hall, type_label, count(*) AS interfaces, count(*) FILTER (WHERE optical) AS optics, {PCT.format(a='count(*) FILTER (WHERE optical)', b='count(*)')} AS pct FROM h GROUP BY ROLLUP (hall, type_label)")
PORTS = f"count(*) AS interfaces, count(*) FILTER (WHERE {OPT}) AS optics, {PCT.format(a=f'count(*) FILTER (WHERE {OPT})', b='count(*)')} AS pct FROM latest WHERE device_name <> ''"
PORT_SETS = {"hall": "hall, site", "hall_type": "hall, type_label, type_category", "type": "type_label, type_category", "category": "type_category", "hall_rack": "hall, rack", "total": ""}


def _ports(kind: str, cols: str) -> str:
    own = cols.split(", ") if cols else []
    shown = ", ".join(c if c in own else f"CAST(NULL AS VARCHAR) AS {c}" for c in ("hall", "site", "type_label", "type_category", "rack"))
    return f"SELECT '{kind}' AS kind, {shown}, {PORTS}" + (" AND rack <> ''" if kind == "hall_rack" else "") + (f" GROUP BY {cols}" if own else "")


register("dashboard_port_inventory", lambda t: q.port_inventory(t), " UNION ALL ".join(_ports(k, v) for k, v in PORT_SETS.items()))
register("dashboard_port_inventory_site", lambda t: q.port_inventory(t, "site1"), " UNION ALL ".join(_ports(k, v) for k, v in PORT_SETS.items()).replace("FROM latest WHERE", "FROM latest WHERE site = 'site1' AND"))
register("dashboard_snapshots", lambda t: q.dashboard_snapshots(t), "SELECT * FROM snapshots ORDER BY snapshot_id DESC LIMIT 10")
register("site_totals", lambda t: q.site_totals(t), "SELECT site, type_category, count(*) AS interfaces, count(DISTINCT device_name) AS devices FROM latest GROUP BY ROLLUP (site, type_category)")
