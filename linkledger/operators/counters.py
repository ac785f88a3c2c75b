"""Counts over cable sheets: three notions of an optic count, and device counts.

per names the columns that tell sheets apart: each sheet is counted on its own. Without it df is one sheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkledger.functions.cells import IN_SERVICE, family, present, safe_cell


def sheet_ends(df: DataFrame, per: tuple[str, ...] = ()) -> DataFrame:
    """The A and Z end of each row, in reading order (A before Z)."""
    names = ("device", "port", "optic", "model", "loc_cab_ru", "locode", "breakout_loc")
    each = [F.struct(F.lit(s.upper()).alias("side"), *[(F.col(f"{s}_{n}") if f"{s}_{n}" in df.columns else F.lit("")).alias(n) for n in names]) for s in "az"]
    return df.select(*per, "row_idx", "status", "status_normalized", F.inline(F.array(*each)))


def flagged_ends(df: DataFrame, per: tuple[str, ...], **flags: Column) -> DataFrame:
    """sheet_ends with flags of the row. They are made before the row becomes two ends, so that an aggregate which sorts the ends
    holds flags and not the texts they come from."""
    return sheet_ends(df.withColumns(flags), (*per, *flags))


def sheet_optics(df: DataFrame, by: str | None = None, per: tuple[str, ...] = ()) -> DataFrame:
    """Optics by name, of ends with a locode. An end without breakout counts when it has an optic; of ends with one, the first
    of each location and port counts. by='service' keeps in-service and other rows apart, each with its own first ends;
    by='status' counts per status, with first ends shared by all."""
    ends = sheet_ends(df, per).where(present("locode")).withColumn("bucket", family("status_normalized", IN_SERVICE) if by == "service" else F.lit(True))
    broken = present("breakout_loc")
    key = F.when(broken, F.concat(F.coalesce("loc_cab_ru", F.lit("nan")), F.coalesce("port", F.lit("nan"))))
    # Ends without breakout need no first: a row's own number keeps them from being one group.
    order = W.partitionBy(*per, "bucket", key, F.when(~broken, F.col("row_idx"))).orderBy("row_idx", "side")
    ends = ends.withColumn("_rn", F.row_number().over(order)).where((broken & (F.col("_rn") == 1)) | (~broken & present("optic")))
    ends = ends.withColumn("optic", F.upper(safe_cell(F.coalesce("optic", F.lit("nan"))))).where(F.length("optic") >= 2)
    keys = {"service": [F.col("bucket").alias("in_service")], "status": [F.coalesce(F.nullif(F.trim("status"), F.lit("")), F.lit("Unknown")).alias("shown")], None: []}[by]
    return ends.groupBy(*per, *keys, "optic").agg(F.count("*").alias("n"))


def optic_cells(df: DataFrame, per: tuple[str, ...] = ()) -> DataFrame:
    """Every filled optic cell counts."""
    return sheet_ends(df, per).where(present("optic")).groupBy(*per, "optic").agg(F.count_if(F.col("side") == "A").alias("a"), F.count_if(F.col("side") == "Z").alias("z"), F.count("*").alias("n"))


def mpo_optics(df: DataFrame, per: tuple[str, ...] = ()) -> DataFrame:
    """A ends count once for each device, port and optic; Z ends for each row."""
    a = df.select(*per, "a_device", "a_port", F.col("a_optic").alias("optic")).distinct().groupBy(*per, "optic").agg(F.count("*").alias("a"))
    z = df.groupBy(*per, F.col("z_optic").alias("optic")).agg(F.count("*").alias("z"))
    both = a.join(z, [*per, "optic"], "full_outer").select(*per, "optic", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("z", F.lit(0)).alias("z"))
    return both.where(present("optic")).withColumn("n", F.col("a") + F.col("z"))


def first_models(df: DataFrame, per: tuple[str, ...] = ()) -> DataFrame:
    """(loc_cab_ru, model, in_service): the model of a location's first end that has one (all A ends before all Z ends), and
    whether any of its ends is in service, with a model or not. Locations without a model are left out."""
    ends = flagged_ends(df, per, service=family("status_normalized", IN_SERVICE)).where(present("loc_cab_ru"))
    at = F.when(present("model"), F.struct("side", "row_idx"))
    each = ends.groupBy(*per, "loc_cab_ru").agg(F.min_by("model", at).alias("model"), F.bool_or(present("model")).alias("has"), F.bool_or("service").alias("in_service"))
    return each.where("has").drop("has")


def sheet_devices(df: DataFrame, per: tuple[str, ...] = ()) -> DataFrame:
    """One device for each location, by model and whether it is in service."""
    return first_models(df, per).groupBy(*per, "model", "in_service").agg(F.count("*").alias("n"))


def uncabled_hosts(df: DataFrame, hosts: DataFrame, per: tuple[str, ...] = ()) -> DataFrame:
    """(host, model, in_service): hosts with a model that no end of their sheet names, each once; names are compared without
    regard to case. hosts: per, hostname, model, status, and optionally row_idx; of repeated names the first row holds."""
    name = lambda c: F.lower(safe_cell(F.col(c)))
    named = df.select(*per, F.explode(F.array(name("a_device"), name("z_device"))).alias("host")).where(present("host")).distinct()
    rows = hosts.withColumn("host", name("hostname")).withColumn("model", safe_cell(F.col("model"))).where(present("host") & present("model"))
    first = F.struct(F.col("row_idx") if "row_idx" in hosts.columns else F.lit(0), "model", "status_normalized")
    rows = rows.groupBy(*per, "host").agg(F.min(first).alias("first")).join(named, [*per, "host"], "left_anti")
    return rows.select(*per, "host", F.col("first.model").alias("model"), family("first.status_normalized", IN_SERVICE).alias("in_service"))


def all_devices(df: DataFrame, hosts: DataFrame, per: tuple[str, ...] = ()) -> DataFrame:
    """Devices by location, and hosts that have no cables, by model (in capitals) and whether they are in service."""
    each = first_models(df, per).select(*per, "model", "in_service").unionByName(uncabled_hosts(df, hosts, per).select(*per, "model", "in_service"))
    each = each.withColumn("model", F.upper(safe_cell(F.col("model")))).where(F.length("model") >= 2)
    return each.groupBy(*per, "model", "in_service").agg(F.count("*").alias("n"))


def cabling_state(df: DataFrame, per: tuple[str, ...] = ()) -> DataFrame:
    """Devices by how far they are cabled, and by the model of the first end seen there (row by row, A before Z), Unknown if that
    has none. A blank status is one of its own: neither passed nor not run."""
    shown = F.trim(F.regexp_replace("status", r"\s+", " "))
    passed = present("status") & family("status_normalized", ("lldp_passed",))
    ends = flagged_ends(df, per, passed=passed, idle=F.coalesce(shown.startswith("Cable Not Run"), F.lit(False))).where(present("loc_cab_ru"))
    each = ends.groupBy(*per, "loc_cab_ru").agg(F.min_by(F.struct("model"), F.struct("row_idx", "side")).alias("first"), F.every("passed").alias("full"), F.every("idle").alias("none"))
    state = F.when(F.col("full"), "Fully Cabled").when(F.col("none"), "Not Cabled").otherwise("Work in Progress")
    model = F.when(present("first.model"), F.col("first.model")).otherwise("Unknown")
    return each.groupBy(*per, state.alias("state"), model.alias("model")).agg(F.count("*").alias("n"))


def model_index(df: DataFrame, per: tuple[str, ...] = ()) -> DataFrame:
    ends = sheet_ends(df, per).where(present("model"))
    return ends.groupBy(*per, F.upper("model").alias("model")).agg(F.count("*").alias("n"), F.count_if(F.col("side") == "A").alias("a"), F.count_if(F.col("side") == "Z").alias("z"), F.countDistinct("loc_cab_ru").alias("locations"))


def model_locations(df: DataFrame, per: tuple[str, ...] = ()) -> DataFrame:
    """How often each model stands at each location, A and Z ends apart."""
    ends = sheet_ends(df, per).where(present("model")).withColumn("model", F.upper("model"))
    return ends.groupBy(*per, "model", "loc_cab_ru").agg(F.count("*").alias("n"), F.count_if(F.col("side") == "A").alias("a"), F.count_if(F.col("side") == "Z").alias("z"))


def roce_status(c: Column | str) -> Column:
    """Status of a row of a RoCE sheet: blank is Unknown, anything that says complete is Complete."""
    text = F.trim(F.col(c) if isinstance(c, str) else c)
    return F.when(~present(text), "Unknown").when(F.lower(text).contains("complete"), "Complete").otherwise(text)


def roce_optics(df: DataFrame, short_ports: bool = False, per: tuple[str, ...] = (), by: str | None = None) -> DataFrame:
    """df: tab, row_idx, device, loc, port, connector, optic. Of rows with a device and an optic, one per tab, location, port and connector; on tabs of tiers 0
    and 1 a port loses its last two characters first. by='status' counts per status of that one row."""
    port = F.expr("substring(port, 1, greatest(length(port) - 2, 0))") if short_ports else F.col("port")
    first = F.row_number().over(W.partitionBy(*per, "tab", "loc", port, "connector").orderBy("row_idx"))
    rows = df.where(present("device") & present("optic")).withColumn("_rn", first).where("_rn = 1").withColumn("optic", F.upper(safe_cell(F.col("optic"))))
    keys = [roce_status("status").alias("shown")] if by == "status" else []
    return rows.where(F.length("optic") >= 2).groupBy(*per, *keys, "optic").agg(F.count("*").alias("n"))


def roce_tab_optics(df: DataFrame, by: str | None = None, per: tuple[str, ...] = ()) -> DataFrame:
    """Optics of both ends of a RoCE workbook's rows. On tabs of nodes to tier 0 a port counts as it is named; on tabs of tier 0 to
    tier 1 two cables share an optic, and the last two characters of a port go. Other tabs and backups don't count. Of ends with a device
    and an optic, one for each tab, location, port and connector, in reading order. by='service' keeps in-service rows and others apart,
    each with its own first ends. df: tab, row_idx, status_normalized, and of both sides device, port, optic, loc_cab_ru, connector."""
    tab, text = F.lower("tab"), lambda c: F.coalesce(c, F.lit("nan"))
    names = ("device", "port", "optic", "loc_cab_ru", "connector")
    each = [F.struct(F.lit(s.upper()).alias("side"), *[F.col(f"{s}_{n}").alias(n) for n in names]) for s in "az"]
    bucket = family("status_normalized", IN_SERVICE) if by == "service" else F.lit(True)
    rows = df.where(~tab.contains("backup") & (tab.contains("node to tier-0") | tab.contains("tier-0 to tier-1")))
    rows = rows.select(*per, "tab", "row_idx", bucket.alias("in_service"), F.inline(F.array(*each))).where(present("device") & present("optic"))
    short = F.when(tab.contains("node to tier-0"), F.col("port")).otherwise(F.expr("substring(port, 1, greatest(length(port) - 2, 0))"))
    place = F.concat(text(F.col("loc_cab_ru")), text(short), text(F.col("connector")))
    first = rows.groupBy(*per, "tab", "in_service", place.alias("place")).agg(F.min_by("optic", F.struct("row_idx", "side")).alias("optic"))
    first = first.withColumn("optic", F.upper(safe_cell(F.col("optic")))).where(F.length("optic") >= 2)
    return first.groupBy(*per, *(["in_service"] if by == "service" else []), "optic").agg(F.count("*").alias("n"))


#: Statuses of a RoCE row that has not been cabled.
NOT_CABLED = ("No Label & Not Yet Run", "Unknown")


def roce_devices(df: DataFrame, per: tuple[str, ...] = ()) -> DataFrame:
    """Locations by how far their rows are cabled, and by the first model given there."""
    shown = roce_status("status")
    ends = flagged_ends(df, per, complete=shown == "Complete", idle=shown.isin(*NOT_CABLED)).withColumns({"loc": safe_cell(F.col("loc_cab_ru")), "name": safe_cell(F.col("model"))}).where(present("loc"))
    each = ends.groupBy(*per, "loc").agg(F.min_by("name", F.when(present("name"), F.struct("row_idx", "side"))).alias("name"), F.every("complete").alias("full"), F.every("idle").alias("none"))
    state = F.when(F.col("full"), "Fully Cabled").when(F.col("none"), "Not Cabled").otherwise("Work in Progress")
    each = each.select(*per, state.alias("state"), F.upper(F.coalesce("name", F.lit("Unknown"))).alias("model"))
    return each.where(F.length("model") >= 2).groupBy(*per, "state", "model").agg(F.count("*").alias("n"))


# Names and marks in InfiniBand workbooks, and words that are no device.
IB_CELL, IB_NODE = "Twin Port OSFP", "IB Node Optic"
IB_NO_DEVICE = ("status", "source", "destination", "n/a", "nan")


def ib_status(c: Column | str) -> Column:
    text = F.trim(F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"\s+", " "))
    return F.when(present(text), text).otherwise("No Status")


def ib_optics(df: DataFrame, by: str | None = None, per: tuple[str, ...] = ()) -> DataFrame:
    """df: tab, status, optic_type, ibp, cells (all of the row). A filled optic type is one optic; on node tabs a filled ibp is
    two node optics, one for each end; on ufm tabs each cell of the twin port name is one. by: 'service' or 'status'."""
    tab = F.lower("tab")
    found = [
        (F.when(present("optic_type"), F.col("optic_type")), F.lit(1)),
        (F.when(tab.contains("node") & present("ibp"), IB_NODE), F.lit(2)),
        (F.when(tab.contains("ufm"), IB_CELL), F.size(F.filter("cells", lambda x: x == IB_CELL))),
    ]
    keys = {"service": [F.coalesce(F.trim("status") == "Complete", F.lit(False)).alias("in_service")], "status": [ib_status("status").alias("shown")], None: []}[by]
    rows = df.select(*per, *keys, F.inline(F.array(*[F.struct(name.alias("optic"), n.alias("times")) for name, n in found]))).where("times > 0")
    rows = rows.withColumn("optic", F.upper(safe_cell(F.col("optic")))).where(F.length("optic") >= 2)
    return rows.groupBy(*per, *[c for c in rows.columns if c in ("in_service", "shown")], "optic").agg(F.sum("times").alias("n"))


def ib_devices(df: DataFrame, by: str | None = None, per: tuple[str, ...] = ()) -> DataFrame:
    """df: tab, status, source, destination. Devices named on pull schedules: words without a space. by='service' parts those with
    a complete row from the others, by='status' parts them by how far their rows are cabled."""
    rows = df.where(F.lower("tab").contains("pull schedule") & (F.upper("tab") != "OVERHEAD"))
    rows = rows.select(*per, "status", F.explode(F.array("source", "destination")).alias("device")).withColumn("device", F.trim("device"))
    rows = rows.where(present("device") & ~F.col("device").contains(" ") & ~F.lower("device").isin(*IB_NO_DEVICE)).withColumn("shown", ib_status("status"))
    each = rows.groupBy(*per, "device").agg(
        F.bool_or(F.col("shown") == "Complete").alias("in_service"), F.every(F.col("shown") == "Cable Is Ran: Complete").alias("full"), F.every(F.col("shown") == "Cable Not Run").alias("none")
    )
    state = F.when(F.col("full"), "Fully Cabled").when(F.col("none"), "Not Cabled").otherwise("Work in Progress")
    keys = {"service": [F.col("in_service")], "status": [state.alias("state")], None: []}[by]
    return each.groupBy(*per, *keys).agg(F.count("*").alias("n"))


def location_optics(df: DataFrame, per: tuple[str, ...] = ()) -> DataFrame:
    """(location of the A end, column, optic, row_idx) for each filled optic cell of rows that have that location."""
    each = F.inline(F.array(*[F.struct(F.lit(c).alias("optic_column"), F.col(c).alias("optic")) for c in ("a_optic", "z_optic")]))
    rows = df.select(*per, "row_idx", F.col("a_loc_cab_ru").alias("location"), each)
    return rows.where(present("location") & present("optic"))


def location_index(df: DataFrame, per: tuple[str, ...] = ()) -> DataFrame:
    """Optics of each location with the rows that show them: how many, the first and the last; location_optics lists all."""
    groups = location_optics(df, per).groupBy(*per, "location", "optic")
    return groups.agg(F.count("*").alias("n"), F.countDistinct("row_idx").alias("rows"), F.min("row_idx").alias("first_row"), F.max("row_idx").alias("last_row"))


def value_counts(df: DataFrame, column: str, per: tuple[str, ...] = ()) -> DataFrame:
    """How often each value of a column stands in all tabs but the overhead one."""
    rows = df.where((F.upper("tab") != "OVERHEAD") & F.col(column).isNotNull())
    return rows.groupBy(*per, F.col(column).alias("value")).agg(F.count("*").alias("n"))


def device_registry(df: DataFrame, per: tuple[str, ...] = ()) -> DataFrame:
    """Devices by lower-case name, location and model, with the sections and sides they appear in. An end is a device if it has a
    name or a location; what is missing is empty."""
    names = ("device", "model", "loc_cab_ru")
    each = [F.struct(F.lit(s.upper()).alias("side"), *[F.col(f"{s}_{n}").alias(n) for n in names]) for s in "az"]
    text = lambda c: F.when(present(c), F.trim(c)).otherwise("").alias(c)
    ends = df.select(*per, "section", F.inline(F.array(*each))).where(present("device") | present("loc_cab_ru")).select(*per, "section", "side", *[text(n) for n in names])
    return ends.groupBy(*per, F.lower("device").alias("device"), "loc_cab_ru", "model").agg(F.sort_array(F.collect_set("section")).alias("sections"), F.sort_array(F.collect_set("side")).alias("sides"), F.count("*").alias("n"))


def link_records(df: DataFrame, per: tuple[str, ...] = ()) -> DataFrame:
    """Rows with a device at an end, and a_breakout, z_breakout (whether the end breaks out) and a_breakout_new_optic: false where an
    earlier row (by row_idx) has the same A location and port and breaks out, too, so that its optic is already counted. An end is a device if
    it has a name or a location. Only rows whose A end breaks out are shuffled."""
    device = lambda s: present(f"{s}_device") | present(f"{s}_loc_cab_ru")
    rows = df.where(device("a") | device("z")).withColumns({f"{s}_breakout": present(f"{s}_breakout_loc") for s in "az"})
    shared = F.col("a_breakout") & device("a")
    place = [F.when(present(c), F.trim(c)).otherwise("") for c in ("a_loc_cab_ru", "a_port")]
    first = F.row_number().over(W.partitionBy(*per, *place).orderBy("row_idx")) == 1
    return rows.where(~shared).withColumn("a_breakout_new_optic", F.lit(True)).unionByName(rows.where(shared).withColumn("a_breakout_new_optic", first))


def top_locations(df: DataFrame, k: int = 10, per: tuple[str, ...] = ()) -> DataFrame:
    """The k commonest locations of each optic."""
    groups = sheet_ends(df, per).where(present("optic") & present("loc_cab_ru")).groupBy(*per, "optic", "loc_cab_ru").agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy(*per, "optic").orderBy(F.desc("n"), "loc_cab_ru"))
    return groups.withColumn("rank", rank).where(F.col("rank") <= k)
