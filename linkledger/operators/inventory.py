"""Inventory questions: each function takes the tables and its parameters and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkledger.functions.cells import CABLE_RUN, FAILED, IN_SERVICE, PENDING, VERIFICATION, at_location, family, hall, percent, present, rack_key
from linkledger.plans.fixture import Tables

from .ingest import with_roles

from .shapes import contains_any, ends, like, physical_optics, scope, status_counts, top, with_group_total

def complete():
    return F.count_if(family("status_normalized", IN_SERVICE))


def optic_count(t: Tables, site_id=None, upload_id=None, optic="", section="", location="") -> DataFrame:
    links = scope(t.links, site_id, upload_id).where(like("section", section))
    if location:
        links = links.where(at_location("a_loc_cab_ru", location) | at_location("z_loc_cab_ru", location))
    rows = physical_optics(ends(links).where(like("optic", optic)))
    counts = rows.groupBy("optic").agg(F.count_if(F.col("side") == "A").alias("a_count"), F.count_if(F.col("side") == "Z").alias("z_count"), F.count("*").alias("total"), *status_counts())
    return top(counts, F.desc("total"), "optic")


def side_device_list(t: Tables, side: str, site_id=None, upload_id=None, limit=200) -> DataFrame:
    rows = scope(t.links, site_id, upload_id).select(F.col(f"{side}_device").alias("device"), F.col(f"{side}_port").alias("port"))
    groups = rows.where(present("device")).groupBy("device").agg(F.count("*").alias("connections"), F.countDistinct("port").alias("ports"))
    return top(with_group_total(groups), F.desc("connections"), "device", limit=limit)


def role_lookup(t: Tables, site_id=None, upload_id=None, role="", side="", device="", limit=200) -> DataFrame:
    """Roles are those of the link's own upload: of its hosts by name, as ingest writes them on the link."""
    links = with_roles(scope(t.links, site_id, upload_id), scope(t.hosts, site_id, upload_id))
    each = [F.struct(F.lit(s.upper()).alias("side"), *[F.col(f"{s}_{c}").alias(c) for c in ("role", "device", "model")]) for s in "az" if side in ("", s.upper())]
    rows = links.select(F.inline(F.array(*each))).where(present("role") & present("device") & like("role", role) & like("device", device))
    groups = rows.groupBy("role", "side", "device").agg(F.expr("mode() within group (order by nullif(model, ''))").alias("model"), F.count("*").alias("connections"))
    return top(groups, "role", "side", "device", limit=limit)


def device_list(t: Tables, site_id=None, upload_id=None, device="", limit: int | None = 200) -> DataFrame:
    rows = ends(scope(t.links, site_id, upload_id)).where(present("device") & like("device", device))
    groups = rows.groupBy("device").agg(F.count("*").alias("connections"), F.countDistinct("port").alias("ports"))
    return top(groups, F.desc("connections"), "device", limit=limit)


#: What names of compute devices contain.
COMPUTE = ("node", "compute", "gpu", "server")


def node_compute(t: Tables, site_id=None, upload_id=None) -> DataFrame:
    rows = ends(scope(t.links, site_id, upload_id)).where(contains_any("device", COMPUTE))
    groups = rows.groupBy("device").agg(F.count("*").alias("connections"), F.countDistinct("port").alias("ports"))
    return top(groups, F.desc("connections"), "device")


def device_connections(t: Tables, device: str, site_id=None, upload_id=None, limit=200) -> DataFrame:
    rows = scope(t.links, site_id, upload_id).where(like("a_device", device) | like("z_device", device))
    return top(rows.select("section", "a_device", "a_port", "z_device", "z_port", "status", "id"), "section", "a_port", "id", limit=limit)


def status_of(t: Tables, slugs, site_id=None, upload_id=None) -> DataFrame:
    rows = scope(t.links, site_id, upload_id).where(F.col("status_normalized").isin(*slugs))
    return top(rows.groupBy("status_normalized", "status").agg(F.count("*").alias("cnt")), F.desc("cnt"), "status")


def section_summary(t: Tables, site_id=None, upload_id=None) -> DataFrame:
    rows = scope(t.links, site_id, upload_id)
    return top(rows.groupBy("section").agg(F.count("*").alias("connections"), F.countDistinct("a_device").alias("a_devices"), F.countDistinct("z_device").alias("z_devices")), F.desc("connections"), "section")


def section_completion(t: Tables, site_id=None, upload_id=None) -> DataFrame:
    known = F.col("status_normalized").isNotNull()
    groups = scope(t.links, site_id, upload_id).groupBy("section").agg(
        F.count("*").alias("total"), complete().alias("complete"), F.count_if(known & ~family("status_normalized", IN_SERVICE)).alias("incomplete")
    )
    return top(groups.withColumn("pct", percent(F.col("complete"), F.col("total"))), F.desc("incomplete"), F.desc("total"), "section")


def lldp_failures(t: Tables, site_id=None, upload_id=None, limit=100) -> DataFrame:
    rows = scope(t.links, site_id, upload_id).where(F.col("status_normalized").isin(*FAILED))
    return top(rows.select("section", "a_device", "a_port", "z_device", "z_port", "id"), "section", "a_device", "id", limit=limit)


def site_overview(t: Tables, site_id=None, upload_id=None) -> DataFrame:
    """Devices are those of A ends."""
    devices = F.countDistinct(F.when(present("a_device"), F.col("a_device")))
    return scope(t.links, site_id, upload_id).agg(F.count("*").alias("connections"), devices.alias("devices"), F.countDistinct("section").alias("sections"))


def data_hall_summary(t: Tables, site_id=None, upload_id=None, hall_prefix="") -> DataFrame:
    rows = scope(t.links, site_id, upload_id).where(present("a_loc_cab_ru")).withColumn("hall", hall("a_loc_cab_ru"))
    rows = rows.where(F.lower("hall").startswith(hall_prefix.lower()))
    return top(rows.groupBy("hall").agg(F.count("*").alias("connections"), F.countDistinct("a_device").alias("devices")), F.desc("connections"), "hall")


def raw_search(t: Tables, text: str, site_id=None, upload_id=None, limit=50) -> DataFrame:
    """Substring search in the rows as compact JSON (missing cells are left out)."""
    cells = ["a_device", "a_port", "a_optic", "z_device", "z_port", "z_optic", "cable_id"]
    rows = scope(t.links, site_id, upload_id).select("id", F.to_json(F.struct(*[F.when(present(c), F.col(c)).alias(c) for c in cells])).alias("raw_row"))
    return top(rows.where(F.lower("raw_row").contains(text.lower())), "id", limit=limit)


def _models(t: Tables, site_id, upload_id, model: str, statuses=()) -> DataFrame:
    """Named ends whose model or device matches, of links in these statuses (none: any)."""
    rows = ends(scope(t.links, site_id, upload_id)).where(present("device") & (like("model", model) | like("device", model)))
    return rows.where(F.col("status_normalized").isin(*statuses)) if statuses else rows


def _at(rows: DataFrame, column: str, location: str, data_hall: str) -> DataFrame:
    for place in (location, data_hall):
        rows = rows.where(at_location(column, place)) if place else rows
    return rows


def _listed(t: Tables, site_id, upload_id, model: str, location: str, data_hall: str) -> DataFrame:
    """Hosts whose model or name matches; with a location none, with a hall those in it."""
    rows = scope(t.hosts, site_id, upload_id).where(like("model", model) | like("hostname", model))
    return _at(rows.where(F.lit(not location)), "rack", "", data_hall)


def model_list(t: Tables, model: str, site_id=None, upload_id=None, statuses=(), data_hall="", location="", limit=200) -> DataFrame:
    """A hall may be that of either end here, and a location that of the own end; the counts below go by the own end. Hosts of the
    inventory are listed, too, unless statuses or a location are asked for."""
    links = scope(t.links, site_id, upload_id)
    if statuses:
        links = links.where(F.col("status_normalized").isin(*statuses))
    if data_hall:
        links = links.where(at_location("a_loc_cab_ru", data_hall) | at_location("z_loc_cab_ru", data_hall))
    rows = ends(links).where(present("device") & (like("model", model) | like("device", model)))
    rows = _at(rows, "loc", location, "").select("device", "model", F.lit(1).alias("one"))
    if not statuses:
        inventory = _listed(t, site_id, upload_id, model, location, data_hall)
        rows = rows.unionByName(inventory.select(F.col("hostname").alias("device"), "model", F.lit(0).alias("one")))
    groups = rows.groupBy("device", "model").agg(F.sum("one").alias("connections"))
    return top(with_group_total(groups), F.desc("connections"), "device", "model", limit=limit)


def _sides() -> list:
    """Rows, two for a link with both ends matching, and those of each side."""
    return [F.count("*").alias("link_rows"), F.count_if(F.col("side") == "A").alias("a_rows"), F.count_if(F.col("side") == "Z").alias("z_rows")]


def model_raw_count(t: Tables, model: str, site_id=None, upload_id=None, data_hall="", location="") -> DataFrame:
    return _at(_models(t, site_id, upload_id, model), "loc", location, data_hall).agg(*_sides(), F.countDistinct("device").alias("devices"))


def model_status_count(t: Tables, model: str, statuses, site_id=None, upload_id=None, data_hall="", location="") -> DataFrame:
    rows = _at(_models(t, site_id, upload_id, model, statuses), "loc", location, data_hall)
    return rows.agg(F.countDistinct(F.when(present("loc"), F.col("loc"))).alias("locations"), F.countDistinct("device").alias("names"), *_sides())


def model_unique_count(t: Tables, model: str, site_id=None, upload_id=None, data_hall="", location="") -> DataFrame:
    rows = _at(_models(t, site_id, upload_id, model), "loc", location, data_hall).select("device", F.lit("links").alias("source"))
    inventory = _listed(t, site_id, upload_id, model, location, data_hall).where(present("hostname")).select(F.col("hostname").alias("device"), F.lit("inventory").alias("source"))
    each = rows.unionByName(inventory).groupBy("device").agg(F.max(F.col("source") == "links").alias("in_links"), F.max(F.col("source") == "inventory").alias("in_inventory"))
    return each.agg(F.count("*").alias("total_devices"), F.count_if("in_links").alias("link_devices"), F.count_if("in_inventory").alias("inventory_devices"))


def link_status(t: Tables, site_id=None, upload_id=None, limit=200) -> DataFrame:
    cols = ["a_device", "a_port", "z_device", "z_port", "link_status", "status", "current_neighbor", "current_neighbor_port", "dct_notes", "id"]
    return top(scope(t.burndown, site_id, upload_id).select(*cols), "link_status", "a_device", "id", limit=limit)


def neighbor_mismatch(t: Tables, site_id=None, upload_id=None, limit=200) -> DataFrame:
    rows = scope(t.burndown, site_id, upload_id).where(present("current_neighbor") & (F.lower(F.trim("current_neighbor")) != F.lower(F.trim("z_device"))))
    return top(rows.select("a_device", "a_port", "z_device", "current_neighbor", "id"), "a_device", "a_port", "id", limit=limit)


def rack_summary(t: Tables, site_id=None, upload_id=None, limit=50) -> DataFrame:
    rows = ends(scope(t.links, site_id, upload_id)).withColumn("rack", rack_key("loc"))
    rows = rows.withColumn("link", F.when(present("cable_id"), F.col("cable_id")).otherwise(F.col("ports"))).where("rack is not null")
    names = lambda c: F.array_join(F.sort_array(F.collect_set(F.when(present(c), F.col(c)))), ", ")
    racks = rows.groupBy("rack").agg(F.countDistinct("link").alias("connections"), F.countDistinct("device").alias("devices"), names("model").alias("models"), names("optic").alias("optics"), F.count_if(present("optic")).alias("optic_rows"))
    each = rows.where(present("optic")).groupBy("rack", "optic").agg(F.count("*").alias("n"))
    parts = each.groupBy("rack").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "optic"))).alias("p"))
    parts = parts.select("rack", F.array_join(F.transform("p", lambda x: F.concat(x["optic"], F.lit(": "), (-x["m"]).cast("string"))), ", ").alias("breakdown"))
    total = rows.agg(F.countDistinct("rack").alias("total_racks"), F.countDistinct("link").alias("site_connections"))
    out = racks.join(parts, "rack", "left").crossJoin(F.broadcast(total))
    return top(out, F.desc("connections"), "rack", limit=limit)


def location_lookup(t: Tables, location: str, site_id=None, upload_id=None, limit=200) -> DataFrame:
    rows = ends(scope(t.links, site_id, upload_id)).where(present("device") & at_location("loc", location))
    rows = rows.select("device", "side", "model", "loc", F.lit("links").alias("source"))
    inventory = scope(t.hosts, site_id, upload_id).where(at_location("rack", location))
    rows = rows.unionByName(inventory.select(F.col("hostname").alias("device"), F.lit("").alias("side"), "model", F.col("rack").alias("loc"), F.lit("inventory").alias("source")))
    groups = rows.groupBy("device", "side", "source").agg(F.expr("mode() within group (order by nullif(model, ''))").alias("model"), F.count("*").alias("connections"), F.min("loc").alias("location"))
    return top(groups, "source", F.desc("connections"), "device", "side", limit=limit)


KEY = ["a_device", "a_port", "z_device", "z_port"]


def upload_diff_rows(t: Tables, old: int, new: int) -> DataFrame:
    """One row per change between two uploads, matched on the four port columns: one full join of both. Statuses are compared as
    displayed, and optics where these agree, null as empty; a changed cell shows old -> new, and nothing if one is null."""
    cells = ["section", "status", "a_optic", "z_optic", "a_model", "z_model", "cable_id"]
    a, b = (t.links.where(F.col("upload_id") == u).select(*KEY, F.struct(*cells).alias(n)) for u, n in ((old, "a"), (new, "b")))
    both = a.join(b, KEY, "full_outer")
    same = lambda c: F.coalesce(F.col(f"a.{c}"), F.lit("")) == F.coalesce(F.col(f"b.{c}"), F.lit(""))
    change = F.when(F.col("b").isNull(), "removed").when(F.col("a").isNull(), "added").when(~same("status"), "status_changed").when(~same("a_optic") | ~same("z_optic"), "optic_changed")
    to = lambda c: F.concat(F.col(f"a.{c}"), F.lit(" -> "), F.col(f"b.{c}"))
    row = lambda c: F.col(f"row.{c}")
    is_ = lambda kind: F.col("change") == kind
    both = both.withColumn("change", change).where("change is not null").withColumn("row", F.coalesce("a", "b"))
    optics = F.concat(to("a_optic"), F.lit(" / "), to("z_optic"))
    return both.select(
        "change", row("section").alias("section"), *KEY, F.when(is_("optic_changed"), optics).otherwise(row("a_optic")).alias("a_optic"), F.when(~is_("optic_changed"), row("z_optic")).alias("z_optic"),
        F.when(is_("status_changed"), to("status")).otherwise(row("status")).alias("status"), row("a_model").alias("a_model"), row("z_model").alias("z_model"), row("cable_id").alias("cable_id"),
    )


def upload_diff(t: Tables, old: int, new: int) -> DataFrame:
    return upload_diff_rows(t, old, new).groupBy("change").agg(F.count("*").alias("cnt"))


def write_upload_diff(t: Tables, old: int, new: int, path: str) -> None:
    """The changes as a table laid out by kind of change, in order over its files; upload_diff has the counts."""
    rows = upload_diff_rows(t, old, new).repartitionByRange("change", "section", *KEY).sortWithinPartitions("change", "section", *KEY)
    rows.write.partitionBy("change").parquet(path)


def upload_list(t: Tables, site_id: int, limit=50) -> DataFrame:
    return top(t.uploads.where(F.col("site_id") == site_id).select("upload_id", "filename", "created_at", "is_active"), F.desc("created_at"), F.desc("upload_id"), limit=limit)


def latest_upload(t: Tables, site_id: int) -> DataFrame:
    return top(t.uploads.where((F.col("site_id") == site_id) & F.col("is_active")).select("upload_id", "filename"), F.desc("upload_id"), limit=1)


def _active(t: Tables) -> DataFrame:
    return t.links.join(t.active, "upload_id")


def cross_site_models(t: Tables) -> DataFrame:
    model = F.coalesce(F.when(present("a_model"), F.col("a_model")), F.when(present("z_model"), F.col("z_model")))
    groups = _active(t).withColumn("model", model).where("model is not null").groupBy("model", "site_code").agg(F.count("*").alias("cnt"))
    return groups.withColumn("sites", F.count("*").over(W.partitionBy("model"))).orderBy("model", "site_code")


def cross_site_optics(t: Tables) -> DataFrame:
    rows = physical_optics(ends(_active(t))).join(t.sites, "site_id")
    return rows.groupBy("optic", "site_code").agg(F.count("*").alias("total"), *status_counts()).orderBy("optic", "site_code")


def cross_site_status(t: Tables) -> DataFrame:
    return _active(t).groupBy("site_code", "status_normalized").agg(F.count("*").alias("cnt")).orderBy("site_code", F.desc("cnt"), "status_normalized")


TREND_SLUGS = ("lldp_passed", "lldp_failed", "human_verified", "complete", "not_run", "not_terminated")


def _trend(t: Tables, site_id: int, links: DataFrame, *keys: str) -> DataFrame:
    """All uploads of a site with counts of their links by the keys, one row for an upload that has none (its total is 1, as a
    left join counts it). Links are counted before they meet the uploads."""
    counts = links.where(F.col("site_id") == site_id).groupBy("upload_id", *keys).agg(F.count("*").alias("total"), *[F.count_if(F.col("status_normalized") == s).alias(s) for s in TREND_SLUGS], complete().alias("completed"))
    rows = t.uploads.where(F.col("site_id") == site_id).select("upload_id", "filename", "created_at").join(counts, "upload_id", "left")
    rows = rows.na.fill(1, ["total"]).na.fill(0, [*TREND_SLUGS, "completed"])
    return rows.withColumn("pct", percent(F.col("completed"), F.col("total")))


def trend_status(t: Tables, site_id: int, limit=10, latest=False) -> DataFrame:
    """Per upload: slug counts, completion and its change since the upload before. Without latest, the oldest ones."""
    groups = _trend(t, site_id, t.links).withColumn("site_id", F.lit(site_id))
    delta = F.col("completed") - F.lag("completed").over(W.partitionBy("site_id").orderBy("created_at", "upload_id"))
    return top(groups.withColumn("delta", delta), F.desc("created_at") if latest else F.asc("created_at"), "upload_id", limit=limit)


def trend_section(t: Tables, site_id: int, section="", limit=100) -> DataFrame:
    """The same by section. Without a section asked for, uploads without links are there, too, their section null."""
    groups = _trend(t, site_id, t.links.where(like("section", section)), "section").where(like("section", section))
    delta = F.col("completed") - F.lag("completed").over(W.partitionBy("section").orderBy("created_at", "upload_id"))
    return top(groups.withColumn("delta", delta), "created_at", F.asc_nulls_last("section"), "upload_id", limit=limit)


def cable_type_summary(t: Tables, site_id=None, upload_id=None) -> DataFrame:
    rows = scope(t.links, site_id, upload_id).where(present("cable_type"))
    return top(rows.groupBy("cable_type").agg(F.count("*").alias("connections"), F.countDistinct("a_device").alias("a_devices"), F.countDistinct("z_device").alias("z_devices")), F.desc("connections"), "cable_type")


def general(t: Tables, site_id=None, upload_id=None) -> DataFrame:
    devices = F.countDistinct(F.when(present("a_device"), F.col("a_device")))
    one = scope(t.links, site_id, upload_id).agg(F.count("*").alias("c"), devices.alias("d"), F.countDistinct("section").alias("s"))
    return one.select(F.expr("stack(3, 'connections', cast(c as string), 'devices', cast(d as string), 'sections', cast(s as string)) as (metric, value)"))


def general_optics(t: Tables, site_id=None, upload_id=None, limit=15) -> DataFrame:
    optic = F.coalesce(F.when(present("a_optic"), F.col("a_optic")), F.when(present("z_optic"), F.col("z_optic")))
    return top(scope(t.links, site_id, upload_id).groupBy(optic.alias("optic")).agg(F.count("*").alias("cnt")), F.desc("cnt"), "optic", limit=limit)


def composite(t: Tables, site_id: int, upload_id: int | None = None, devices=20, optics=15) -> DataFrame:
    """What is told of a site when nothing else is asked: its commonest devices, all statuses as displayed, its commonest optics (the A
    optic, or the Z optic where that is empty; nan is none), each with all, in-service and failed links. Without an upload
    the latest active one, or all if none is active. One scan, one exchange of partial counts; ties go by name."""
    if upload_id is None:
        last = t.uploads.where((F.col("site_id") == site_id) & F.col("is_active")).orderBy(F.desc("created_at"), F.desc("upload_id")).select("upload_id").first()
        upload_id = last and last[0]
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    named = [("device", F.col("a_device")), ("device", F.col("z_device")), ("status", F.col("status")), ("optic", F.coalesce(filled("a_optic"), filled("z_optic")))]
    each = F.inline(F.array(*[F.struct(F.lit(part).alias("part"), c.alias("name")) for part, c in named]))
    rows = scope(t.links, site_id, upload_id).select("status_normalized", each).where((F.col("part") == "status") | present("name"))
    groups = rows.groupBy("part", "name").agg(F.count("*").alias("n"), *status_counts()[:2])
    rank = F.row_number().over(W.partitionBy("part").orderBy(F.desc("n"), F.asc_nulls_first("name")))
    most = F.when(F.col("part") == "device", devices).when(F.col("part") == "optic", optics)
    return top(groups.withColumn("rank", rank.cast("long")).where(most.isNull() | (F.col("rank") <= most)), "part", "rank")


# Views over active uploads.


def optic_inventory_by_side(t: Tables) -> DataFrame:
    return ends(_active(t)).where(present("optic")).groupBy("site_id", "optic", "side").agg(F.count("*").alias("total"), *status_counts())


def optic_inventory_combined(t: Tables) -> DataFrame:
    optic = F.coalesce(F.when(present("a_optic"), F.col("a_optic")), F.when(present("z_optic"), F.col("z_optic")))
    return _active(t).withColumn("optic", optic).where("optic is not null").groupBy("site_id", "optic").agg(F.count("*").alias("total"), *status_counts())


def cable_status_summary(t: Tables) -> DataFrame:
    return _active(t).groupBy("site_id", "section", "status", "status_normalized").agg(F.count("*").alias("cnt"))


def device_summary(t: Tables) -> DataFrame:
    rows = ends(_active(t)).where(present("device"))
    return rows.groupBy("site_id", "device").agg(F.max(F.when(present("model"), F.col("model"))).alias("model"), F.count("*").alias("connections"), F.countDistinct("port").alias("ports"))


# Dashboard: all over the latest good snapshot.


def latest_snapshot(t: Tables) -> DataFrame:
    return top(t.snapshots.where("status = 'ok'"), F.desc("snapshot_id"), limit=1)


def _latest(t: Tables, site: str | None = None) -> DataFrame:
    last = t.snapshots.where("status = 'ok'").agg(F.max("snapshot_id").alias("snapshot_id"))
    rows = t.interfaces.join(F.broadcast(last), "snapshot_id")
    return rows if site is None else rows.where(F.col("site") == site)


def _named(t: Tables, site: str | None = None) -> DataFrame:
    return _latest(t, site).where("device_name is not null and device_name <> ''")


def dashboard_summary(t: Tables) -> DataFrame:
    groups = _named(t).groupBy("device_status").agg(F.countDistinct("device_name").alias("devices"))
    return groups.withColumn("healthy", F.col("device_status").isin("active", "provisioned")).orderBy("device_status")


def dashboard_sites(t: Tables) -> DataFrame:
    blank = F.nullif(F.trim("hall"), F.lit(""))
    return _named(t).groupBy("site").agg(F.countDistinct("device_name").alias("devices"), F.countDistinct(blank).alias("halls")).orderBy("site")


def dashboard_halls(t: Tables) -> DataFrame:
    """Devices, interfaces and racks by hall, of rows with a device name; racks without a name don't count. One pass."""
    rows = _named(t).withColumn("hall", F.coalesce(F.nullif(F.trim("hall"), F.lit("")), F.lit("unassigned")))
    racks = F.countDistinct(F.when(F.col("rack") != "", F.col("rack")))
    return rows.groupBy("site", "hall").agg(F.countDistinct("device_name").alias("devices"), F.count("*").alias("interfaces"), racks.alias("racks")).orderBy("site", "hall")


def dashboard_models(t: Tables, limit=20) -> DataFrame:
    return top(_named(t).groupBy("model").agg(F.countDistinct("device_name").alias("devices")), F.desc("devices"), "model", limit=limit)


def dashboard_hall_models(t: Tables) -> DataFrame:
    """Devices by hall and model."""
    return top(_named(t).groupBy("hall", "model").agg(F.countDistinct("device_name").alias("devices")), "hall", F.desc("devices"), "model")


#: What the category of an interface that takes an optic contains.
OPTICAL = ("optical", "infiniband", "fibre")


def dashboard_optics(t: Tables, limit=25) -> DataFrame:
    """Ports by label and category, and whether the category is one of optics."""
    groups = _named(t).groupBy("type_label", "type_category").agg(F.count("*").alias("ports"))
    return top(groups.withColumn("optical", contains_any("type_category", OPTICAL)), F.desc("ports"), "type_label", "type_category", limit=limit)


def dashboard_utilization(t: Tables) -> DataFrame:
    """Interfaces, those that take an optic and their share, by hall and label, with totals of each hall and of all."""
    rows = _named(t).withColumn("hall", F.coalesce(F.nullif(F.trim("hall"), F.lit("")), F.lit("unassigned")))
    groups = rows.rollup("hall", "type_label").agg(F.count("*").alias("interfaces"), F.count_if(contains_any("type_category", OPTICAL)).alias("optics"))
    return groups.withColumn("pct", percent(F.col("optics"), F.col("interfaces")))


#: What a row of port_inventory is about, by the bits of the columns that its group leaves out (hall, site, type_label, type_category, rack).
GROUPS = {0b00111: "hall", 0b01001: "hall_type", 0b11001: "type", 0b01110: "hall_rack", 0b11101: "category", 0b11111: "total"}


def port_inventory(t: Tables, site: str | None = None) -> DataFrame:
    """Interfaces and those that take an optic, with their share, by hall, hall and type, type, category, rack of a hall, and
    in all: one scan, one exchange. Interfaces of devices without a name don't count, and racks without a name are left out."""
    sets = [["hall", "site"], ["hall", "type_label", "type_category"], ["type_label", "type_category"], ["hall", "rack"], ["type_category"], []]
    optic = contains_any("type_category", OPTICAL)
    rows = _named(t, site).select("hall", "site", "type_label", "type_category", "rack", optic.alias("optic"))
    groups = rows.groupingSets(sets, "hall", "site", "type_label", "type_category", "rack").agg(F.count("*").alias("interfaces"), F.count_if("optic").alias("optics"), F.grouping_id().alias("gid"))
    kind = F.element_at(F.create_map(*[F.lit(x) for k, v in GROUPS.items() for x in (k, v)]), F.col("gid").cast("int"))
    groups = groups.withColumn("kind", kind).where((F.col("kind") != "hall_rack") | (F.coalesce("rack", F.lit("")) != ""))
    return groups.select("kind", "hall", "site", "type_label", "type_category", "rack", "interfaces", "optics", percent(F.col("optics"), F.col("interfaces")).alias("pct"))


def dashboard_snapshots(t: Tables, limit=10) -> DataFrame:
    return top(t.snapshots, F.desc("snapshot_id"), limit=limit)


def site_totals(t: Tables) -> DataFrame:
    return _latest(t).rollup("site", "type_category").agg(F.count("*").alias("interfaces"), F.countDistinct("device_name").alias("devices"))
