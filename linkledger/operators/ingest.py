"""From raw cable sheets to link rows, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkledger.functions.cells import SLUGS, clean_cell, display_status, literal_map, model_name, present, replaced, status_slug


# Column names of the known sheet layouts, the preferred one of each target first.
STANDARD_V1 = {
    "A-SIDE-DNS-NAME": "a_device",
    "A-SIDE DEVICE NAME": "a_device",
    "A-SIDE PORT": "a_port",
    "A-PORT": "a_port",
    "A-OPTIC": "a_optic",
    "A-SIDE LOCODE": "a_locode",
    "A-MODEL": "a_model",
    "A-LOC:CAB:RU": "a_loc_cab_ru",
    "A-BREAKOUT LOC:CAB:RU": "a_breakout_loc",
    "A-BREAKOUT SLOT:PORT": "a_breakout_port",
    "A-PATCH-PANEL LOC:CAB:RU:PORT": "a_patch_panel",
    "Z-SIDE-DNS-NAME": "z_device",
    "Z-SIDE DEVICE NAME": "z_device",
    "Z-SIDE PORT": "z_port",
    "Z-PORT": "z_port",
    "Z-OPTIC": "z_optic",
    "Z-SIDE LOCODE": "z_locode",
    "Z-MODEL": "z_model",
    "Z-LOC:CAB:RU": "z_loc_cab_ru",
    "Z-BREAKOUT LOC:CAB:RU": "z_breakout_loc",
    "Z-BREAKOUT SLOT:PORT": "z_breakout_port",
    "Z-PATCH-PANEL LOC:CAB:RU:PORT": "z_patch_panel",
    "Section": "section",
    "CABLE ID": "cable_id",
    "CABLE": "cable_id",
    "STATUS": "status",
}
STANDARD_V2 = {
    "A SIDE DEVICE": "a_device",
    "A-SIDE DEVICE": "a_device",
    "A SIDE PORT": "a_port",
    "A OPTIC": "a_optic",
    "A-OPTIC": "a_optic",
    "A LOCODE": "a_locode",
    "A LOC:CAB:RU": "a_loc_cab_ru",
    "A-LOC:CAB:RU": "a_loc_cab_ru",
    "A MODEL": "a_model",
    "A-MODEL": "a_model",
    "Z SIDE DEVICE": "z_device",
    "Z-SIDE DEVICE": "z_device",
    "Z SIDE PORT": "z_port",
    "Z OPTIC": "z_optic",
    "Z-OPTIC": "z_optic",
    "Z LOCODE": "z_locode",
    "Z LOC:CAB:RU": "z_loc_cab_ru",
    "Z-LOC:CAB:RU": "z_loc_cab_ru",
    "Z MODEL": "z_model",
    "Z-MODEL": "z_model",
    "TOPOLOGY SECTION": "section",
    "CABLE": "cable_id",
    "INSTALL STATUS": "status",
}
ALTERNATE = {
    "Source Device": "a_device",
    "Source Port": "a_port",
    "Source Optic": "a_optic",
    "Source Location": "a_locode",
    "Dest Device": "z_device",
    "Dest Port": "z_port",
    "Dest Optic": "z_optic",
    "Dest Location": "z_locode",
    "Topology": "section",
    "Cable Number": "cable_id",
    "State": "status",
}
# The same for host tabs.
HOSTS_V1 = {
    "DNS-A-RECORD": "hostname",
    "Hostname": "hostname",
    "NETBOX MODEL": "model",
    "Model": "model",
    "Role": "role",
    "ROW:TYPE": "row_type",
    "LOC:ROW:TYPE": "row_type",
    "LOC:CAB:RU": "rack",
    "Rack": "rack",
    "LOCODE": "locode",
    "Data Hall": "data_hall",
    "Status": "status",
}
HOSTS_V2 = {
    "Device Name": "hostname",
    "Device Model": "model",
    "Device Role": "role",
    "Rack Location": "rack",
    "Hall": "data_hall",
    "Install Status": "status",
}
HOST_LAYOUTS = {"standard_v1": HOSTS_V1, "standard_v2": HOSTS_V2}
LAYOUTS = {
    "standard_v1": (STANDARD_V1, ("A-SIDE-DNS-NAME", "A-OPTIC", "Z-OPTIC", "A-MODEL")),
    "standard_v2": (STANDARD_V2, ("TOPOLOGY SECTION", "A SIDE DEVICE", "Z SIDE DEVICE", "INSTALL STATUS")),
    "alternate": (ALTERNATE, ("Source Device", "Dest Device", "Source Optic", "Cable Number")),
}
REQUIRED = ("status", "a_device", "a_port", "a_optic", "z_device", "z_port", "z_optic")
# Words that mark a section header wherever they stand, tiers and roles and then kinds of equipment; words that mark one
# at the end of a chain of names; forms of the other headers.
TIERS = ("TIER", "SPINE", "LEAF", "TOR", "FDP", "CDU", "PDU", "EOR", "MOR", "AGG", "CORE", "BORDER", "MGMT", "OOB", "FABRIC", "ROW", "DH", "ISL")
KINDS = ("GPU", "NVLINK", "COMPUTE", "STORAGE", "NETWORK", "INFRA", "UPLINK", "DOWNLINK", "INTERCONNECT")
CHAINED = ("SPINE", "LEAF", "TOR", "FDP", "CDU", "AGG")
NUMBERED, CHAIN, HYPHENED = r"^(SECTION|TOPOLOGY)\s*[-_]?\s*\w", r"\w+-\w+-\w+(.*)$", r"^[A-Z][A-Z0-9]*[-_][A-Z]"


def topology_like(c: Column) -> Column:
    """Whether a text reads like the name of a part of the topology."""
    text = F.upper(c)
    named = F.arrays_overlap(F.split(text, r"\W+"), F.array(*[F.lit(w) for w in (*TIERS, *KINDS)]))
    after = F.regexp_extract(text, CHAIN, 1)
    chained = F.lit(False)
    for w in CHAINED:
        chained |= after.contains(w)
    return named | text.rlike(NUMBERED) | text.rlike(HYPHENED) | (text.rlike(CHAIN) & chained)


def _plain(name: str) -> str:
    return name.replace("\n", " ").strip().lower()


def detect_layout(columns: list[str], threshold: float = 0.75) -> str | None:
    """The layout of which most fingerprint columns are there; of equals the first, below the threshold none."""
    have = {_plain(c) for c in columns}
    scores = {name: sum(_plain(c) in have for c in marks) / len(marks) for name, (_, marks) in LAYOUTS.items()}
    best = max(scores, key=scores.get)
    return best if scores[best] >= threshold else None


def canonical(df: DataFrame, layout: str, names: dict[str, str] | None = None, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """Columns of the layout (or those of `names`) under their canonical names; a blank cell takes the next source column of its target."""
    own = {_plain(c): c for c in df.columns}
    sources: dict[str, list[str]] = {}
    for name, target in (names or LAYOUTS[layout][0]).items():
        if _plain(name) in own and own[_plain(name)] not in sources.get(target, []):
            sources.setdefault(target, []).append(own[_plain(name)])
    missing = [c for c in required if c not in sources]
    if missing:
        raise ValueError(f"columns missing from the sheet: {', '.join(missing)}")
    cell = lambda c: F.nullif(F.trim(F.col(f"`{c}`")), F.lit(""))
    kept = [F.col(c) for c in ("file", "row_idx") if c in df.columns]
    return df.select(*kept, *[F.coalesce(*[cell(c) for c in cols], F.lit("")).alias(target) for target, cols in sources.items()])


def with_sections(df: DataFrame, named: bool = True) -> DataFrame:
    """Header rows name the section of the rows below them: a status that is none of the known ones, no A location, no A
    device; named: and that reads like a part of the topology. Rows before the first header are UNKNOWN. The window runs over
    one file at a time."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")).isin("", "nan") if c in df.columns else F.lit(True)
    status = F.trim(F.col("status"))
    header = ~blank("status") & blank("a_loc_cab_ru") & blank("a_device") & ~F.lower(status).isin(*SLUGS)
    if named:
        header &= topology_like(status)
    by = W.partitionBy("file").orderBy("row_idx").rowsBetween(W.unboundedPreceding, W.currentRow)
    out = df.withColumn("is_header", F.coalesce(header, F.lit(False)))
    return out.withColumn("section", F.coalesce(F.last(F.when(F.col("is_header"), status), ignorenulls=True).over(by), F.lit("UNKNOWN")))


def with_data(df: DataFrame) -> DataFrame:
    cols = [c for c in ("a_loc_cab_ru", "a_device", "z_loc_cab_ru", "a_optic", "z_optic") if c in df.columns]
    any_ = F.lit(False)
    for c in cols:
        any_ |= present(F.trim(F.col(c)))
    return df.where(any_)


def split_cable_types(df: DataFrame, most_share: float = 0.05, most_kinds: int = 50) -> DataFrame:
    """A cable_id column with few distinct values is a cable type. One aggregate decides."""
    n, kinds = df.where(present("cable_id")).agg(F.count("*"), F.countDistinct("cable_id")).first()
    if n and kinds / n < most_share and kinds < most_kinds:
        return df.withColumn("cable_type", F.col("cable_id")).withColumn("cable_id", F.lit(""))
    return df.withColumn("cable_type", F.lit(""))


def raw_json(columns: list[str]):
    """The row's cells that are filled, as compact JSON."""
    return F.to_json(F.struct(*[clean_cell(F.col(f"`{c}`")).alias(c) for c in columns]))


def physical_links(df: DataFrame) -> DataFrame:
    """One row of each (upload, devices and ports), the first; rows without any port field are all kept. One pass over df: rows that are
    all kept are groups of their own."""
    key = ["upload_id", "a_device", "a_port", "z_device", "z_port"]
    some = F.lit(False)
    for c in key[1:]:
        some |= present(c)
    first = F.row_number().over(W.partitionBy(*key, F.when(~some, F.col("row_idx"))).orderBy("row_idx"))
    return df.withColumn("_rn", first).where((F.col("_rn") == 1) | ~some).drop("_rn")


def insert_new(rows: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key the table has not, one for each key."""
    return rows.dropDuplicates(key).join(existing.select(*key), key, "left_anti")


def with_roles(links: DataFrame, hosts: DataFrame) -> DataFrame:
    """a_role and z_role by host name, in the same upload; of duplicate hosts the least role."""
    roles = hosts.groupBy("upload_id", F.lower(F.trim("hostname")).alias("_h")).agg(F.min("role").alias("_role"))
    for s in ("a", "z"):
        own = roles.select(F.col("upload_id").alias("_u"), "_h", F.col("_role").alias(f"{s}_role"))
        links = links.join(own, (links["upload_id"] == own["_u"]) & (F.lower(F.trim(f"{s}_device")) == own["_h"]), "left").drop("_u", "_h")
    return links


def settled(df: DataFrame, aliases: dict[str, str] | None = None, statuses: dict[str, str] | None = None, models: dict[str, str] | None = None) -> DataFrame:
    """Canonical columns with statuses as displayed, models by their aliases, optics without nan. statuses and models are a site's
    own names, which go before the general ones."""
    cols = {"status": replaced(display_status("status"), statuses)} if "status" in df.columns else {}
    for c in ("a_model", "z_model", "model"):
        if c in df.columns:
            cols[c] = replaced(model_name(F.col(c), aliases) if aliases else F.trim(c), models)
    for c in ("a_optic", "z_optic"):
        if c in df.columns:
            text = F.trim(F.coalesce(c, F.lit("")))
            cols[c] = F.when(F.lower(text) == "nan", "").otherwise(text)
    return df.withColumns(cols)


def load_links(raw: DataFrame, site_id: int, upload_id: int, aliases: dict[str, str] | None = None, statuses: dict[str, str] | None = None, models: dict[str, str] | None = None) -> DataFrame:
    """A raw sheet as link rows; aliases, statuses and models as in settled()."""
    layout = detect_layout(raw.columns)
    if layout is None:
        raise ValueError("no known layout fits these columns")
    df = with_data(with_sections(settled(canonical(raw, layout), aliases, statuses, models)).where("not is_header")).drop("is_header")
    if "cable_id" in df.columns:
        df = split_cable_types(df)
    df = df.withColumns({"status_normalized": status_slug("status"), "site_id": F.lit(site_id), "upload_id": F.lit(upload_id)})
    return physical_links(df)


def load_hosts(raw: DataFrame, layout: str, site_id: int, upload_id: int, aliases: dict[str, str] | None = None) -> DataFrame:
    """A host tab as rows of the inventory, by the layout of its workbook's link tab. Rows without a host name are left out;
    a blank status stays blank. A layout without columns for hosts takes the tab as it is."""
    names = HOST_LAYOUTS.get(layout) or {c: c.lower() for c in raw.columns}
    rows = canonical(raw, layout, names, ("hostname",))
    text = lambda c: F.coalesce(clean_cell(c), F.lit("")) if c in rows.columns else F.lit("")
    cols = {c: text(c) for c in ("hostname", "model", "role", "rack", "data_hall", "status", "row_type")}
    rows = rows.select(*[c for c in ("file", "row_idx") if c in rows.columns], *[v.alias(k) for k, v in cols.items()]).where("hostname <> ''")
    model = model_name(F.col("model"), aliases) if aliases else F.col("model")
    slug = F.when(F.col("status") == "", "").otherwise(status_slug("status"))
    return rows.withColumns({"model": model, "status_normalized": slug, "site_id": F.lit(site_id), "upload_id": F.lit(upload_id)})


def load_burndown(df: DataFrame) -> DataFrame:
    rows = df.where(present("a_device") | present("z_device"))
    row = F.expr("try_cast(try_cast(cutsheet_row as double) as int)")
    return rows.withColumns({"link_status": F.nullif(F.lower(F.trim("link_status")), F.lit("")), "cutsheet_row": row})


def classify_status(c, known: dict[str, str], headers: tuple[str, ...] = ()):
    """Class of a status: as known, then in lower case, then a header of the site; else UNKNOWN. Blank: BLANK."""
    text = F.col(c) if isinstance(c, str) else c
    low = F.lower(F.trim(text))
    found = F.coalesce(F.try_element_at(literal_map(known), text), F.try_element_at(literal_map({k.lower(): v for k, v in known.items()}), low))
    own = F.when(text.isin(*headers), "SECTION_HEADER") if headers else F.lit(None).cast("string")
    return F.when(F.coalesce(low, F.lit("")) == "", "BLANK").otherwise(F.coalesce(found, own, F.lit("UNKNOWN")))


def with_status_class(df: DataFrame, known: dict[str, str], headers: tuple[str, ...] = ()) -> DataFrame:
    """status_class; unknown ones on rows without an optic that read like a part of the topology are section headers."""
    named = F.col("status_class")
    header = (named == "UNKNOWN") & ~present("a_optic") & ~present("z_optic") & topology_like(F.col("status"))
    return df.withColumn("status_class", classify_status("status", known, headers)).withColumn("status_class", F.when(header, "SECTION_HEADER").otherwise(named))


#: Device statuses that count as live.
LIVE = ("active", "provisioned")


def live_devices(df: DataFrame) -> DataFrame:
    """Devices in use, their position in the rack a whole number or null."""
    return df.where(F.col("status").isin(*LIVE)).withColumn("position", F.expr("try_cast(try_cast(position as double) as int)"))


def views_stale(uploads: DataFrame, refreshes: DataFrame) -> DataFrame:
    """One row, stale: an upload is newer than the last refresh, or there has been none. Without uploads nothing is stale."""
    last = uploads.agg(F.max("created_at").alias("upload")).crossJoin(F.broadcast(refreshes.agg(F.max("refreshed_at").alias("refresh"))))
    return last.select((F.col("upload").isNotNull() & F.coalesce(F.col("upload") > F.col("refresh"), F.lit(True))).alias("stale"))


def row_filter(df: DataFrame, terms: list[tuple[str, str, str, str]]) -> DataFrame:
    """terms: (joiner, column, operator, value), folded from left to right; unknown columns are left out."""
    tests = {
        "eq": lambda c, v: c == v, "neq": lambda c, v: c != v, "contains": lambda c, v: F.lower(c).contains(v.lower()),
        "startswith": lambda c, v: c.startswith(v), "endswith": lambda c, v: c.endswith(v),
    }
    whole = None
    for joiner, column, op, value in terms:
        if column in df.columns and op in tests:
            one = tests[op](F.coalesce(F.col(column), F.lit("")), value)
            whole = one if whole is None else (whole | one if joiner == "or" else whole & one)
    return df if whole is None else df.where(whole)
