"""One rack or room of a sheet: its links, devices and optics; per names the columns that tell sheets apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkledger.functions.cells import hall, natural_key, present, rack_number

from .counters import sheet_ends


def resolve_room(df: DataFrame, room: str) -> str:
    """The hall whose name begins with room; more than one is an error."""
    found = sheet_ends(df).select(F.lower(hall("loc_cab_ru")).alias("h")).where(F.col("h").startswith(room.lower())).distinct().limit(3).collect()
    names = sorted(r["h"] for r in found)
    if room.lower() in names:
        return room.lower()
    if len(names) != 1:
        raise ValueError(f"{room} fits {'several halls: ' + ', '.join(names) if names else 'no hall'}")
    return names[0]


def _in(loc: str, room: str, rack: str | None) -> Column:
    test = F.lower(hall(loc)) == room
    return F.coalesce(test if rack is None else test & (rack_number(loc) == (rack.lstrip("0") or "0")), F.lit(False))


def rack_links(df: DataFrame, room: str, rack: str | None = None) -> DataFrame:
    """Links with an end in the rack (or room); inside: both ends are."""
    a, z = _in("a_loc_cab_ru", room, rack), _in("z_loc_cab_ru", room, rack)
    return df.where(a | z).withColumn("inside", a & z)


def rack_devices(df: DataFrame, room: str, rack: str, hosts: DataFrame | None = None, per: tuple[str, ...] = ()) -> DataFrame:
    """Devices in the rack from either end, with what the host table fills in; Pending if no cable of theirs was run."""
    ends = sheet_ends(df, per).where(_in("loc_cab_ru", room, rack) & present("device"))
    at = F.struct("side", "row_idx")
    own = ends.groupBy(*per, F.lower("device").alias("device")).agg(
        F.min_by(F.when(present("model"), F.col("model")), at).alias("model"), F.min("loc_cab_ru").alias("loc"), F.count("*").alias("cables"), F.every(F.col("status_normalized") == "not_run").alias("idle")
    )
    if hosts is not None:
        there = hosts.where(_in("rack", room, rack)).groupBy(*per, F.lower("hostname").alias("device")).agg(F.min("model").alias("h_model"), F.min("rack").alias("h_loc"))
        own = own.join(there, [*per, "device"], "full_outer").withColumns({"model": F.coalesce("model", "h_model"), "loc": F.coalesce("loc", "h_loc"), "cables": F.coalesce("cables", F.lit(0))})
    state = F.when(F.col("idle"), "Pending").when(F.col("cables") > 0, "Installed").otherwise("Listed")
    return own.select(*per, "device", "model", "loc", "cables", state.alias("state")).orderBy(*per, natural_key("device"))


def rack_optics(df: DataFrame, room: str, rack: str, per: tuple[str, ...] = ()) -> DataFrame:
    return sheet_ends(df, per).where(_in("loc_cab_ru", room, rack) & present("optic")).groupBy(*per, "optic").agg(F.count("*").alias("n"))


def overhead_types(cells: DataFrame) -> DataFrame:
    """cells: row, col, value of a floor grid. A number with a label right below it is a rack with that cabinet type; of
    several the first holds, reserved ones are left out."""
    number = cells.where(F.col("value").rlike(r"^\d+$"))
    below = cells.where(~F.col("value").rlike(r"^\d+$")).select((F.col("row") - 1).alias("row"), "col", F.col("value").alias("cab_type"))
    pairs = number.join(below, ["row", "col"]).where(~F.upper("cab_type").startswith("RES"))
    return pairs.groupBy(F.col("value").alias("rack")).agg(F.min_by("cab_type", F.struct("row", "col")).alias("cab_type"))


def cab_summary(df: DataFrame, types: DataFrame, room: str, per: tuple[str, ...] = ()) -> DataFrame:
    racks = sheet_ends(df, per).where(_in("loc_cab_ru", room, None)).select(*per, rack_number("loc_cab_ru").alias("rack")).distinct()
    return racks.join(types, "rack", "left").groupBy(*per, F.coalesce("cab_type", F.lit("Unknown")).alias("cab_type")).agg(F.count("*").alias("racks"))


# Labels of the columns of an elevation tab, and what the tab's name begins with.
ELEVATION = {"ru": "RU-BASE", "device_name": "DEVICE NAME", "device_type": "NETBOX-DEVICE-TYPE"}
ELEVATION_TAB = "ELEV "


def elevations(cells: DataFrame, per: tuple[str, ...] = ()) -> DataFrame:
    """cells: tab, row, col, value of grids. (cab_type, row, ru, device_name, device_type) of the rows below the header of each
    elevation tab, which is its first row with the label of a unit or a name; columns are where the header has their labels (of a
    label that repeats the last). Rows without unit and name are left out. All tabs at a time, by aggregates of their cells."""
    key = [*per, "tab"]
    label = F.upper(F.trim("value"))
    own = cells.where(F.col("tab").startswith(ELEVATION_TAB)).withColumn("label", label)
    heads = own.where(F.col("label").isin(ELEVATION["ru"], ELEVATION["device_name"])).groupBy(*key).agg(F.min("row").alias("head"))
    rows = own.join(heads, key)
    places = rows.where("row = head").groupBy(*key).agg(*[F.max(F.when(F.col("label") == v, F.col("col"))).alias(f"at_{k}") for k, v in ELEVATION.items()])
    cell = lambda k: F.coalesce(F.trim(F.max(F.when(F.col("col") == F.col(f"at_{k}"), F.col("value")))), F.lit("")).alias(k)
    out = rows.where("row > head").join(places, key).groupBy(*key, "row").agg(*[cell(k) for k in ELEVATION])
    out = out.withColumn("ru", F.regexp_replace("ru", r"^(-?\d+)\.0+$", "$1")).where("ru <> '' or device_name <> ''")
    return out.select(*per, F.expr(f"substring(tab, {len(ELEVATION_TAB) + 1})").alias("cab_type"), "row", *ELEVATION)
