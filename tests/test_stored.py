"""Batches, refreshed views, workbooks, contexts over files and exports."""

import datetime
import os
import re
import zipfile
from xml.sax.saxutils import escape

import pytest
from pyspark.sql import functions as F

from linkledger.functions import cells
from linkledger.operators import context, counters, ingest, rack, refresh
from linkledger.plans.fixture import Tables
from linkledger.sources import exports, ledger, readers, workbook

KEYED = "k int, v string"


def test_batches(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *x: spark.createDataFrame(list(x), KEYED)
    now = lambda version=None: sorted((r["k"], r["v"]) for r in ledger.current(spark, path, KEYED, version).collect())
    assert now() == [] and ledger.commits(spark, path).count() == 0
    assert ledger.add_batch(spark, path, rows((1, "a"), (2, "b"), (2, "a")), ["k"]) == 1
    assert ledger.add_batch(spark, path, rows((2, "new"), (3, "c")), ["k"]) == 2
    assert now() == [(1, "a"), (2, "a"), (3, "c")] and now(1) == [(1, "a"), (2, "a")]
    assert ledger.add_batch(spark, path, rows((2, "new"), (3, "c")), ["k"]) == 3 and now() == now(2)
    ledger.add_batch(spark, path, rows((3, "d")), ["k"], replace=True)
    assert sorted((r["k"], r["v"]) for r in ledger.by_key(ledger.current(spark, path, KEYED), ["k"]).collect()) == [(1, "a"), (2, "a"), (3, "d")]


def test_broken_batches(spark, tmp_path):
    """A batch that fails says so; one that is killed after it wrote its rows is not there, and adds its rows once when repeated."""
    path = str(tmp_path / "t")
    good = spark.createDataFrame([(1, "a")], KEYED)
    ledger.add_batch(spark, path, good, ["k"])
    with pytest.raises(Exception, match="broken"):
        ledger.add_batch(spark, path, good.withColumn("v", F.raise_error(F.lit("broken")).cast("string")), ["v"])
    states = [(r["version"], r["status"], r["error"] is None) for r in ledger.commits(spark, path).orderBy("version").collect()]
    assert states == [(1, "ok", True), (2, "failed", False)]
    spark.createDataFrame([(2, "half")], KEYED).write.parquet(f"{path}/rows/version=3/batch-killed")
    assert [r["k"] for r in ledger.current(spark, path, KEYED).collect()] == [1]
    ledger.add_batch(spark, path, spark.createDataFrame([(2, "half")], KEYED), ["k"])
    assert sorted(r["k"] for r in ledger.current(spark, path, KEYED).collect()) == [1, 2]


def test_sites(spark, tmp_path):
    path = str(tmp_path / "sites")
    found = lambda *x: spark.createDataFrame(list(x), "site_code string, site_name string")
    one = {r["site_code"]: r for r in ledger.upsert_sites(spark, path, found(("x", None), ("y", "Y"))).collect()}
    two = {r["site_code"]: r for r in ledger.upsert_sites(spark, path, found(("x", "X"), ("z", ""))).collect()}
    assert one["x"]["site_name"] == "x" and two["x"]["site_name"] == "X" and two["y"] == one["y"]
    assert two["x"]["site_id"] == one["x"]["site_id"] and len({r["site_id"] for r in two.values()}) == 3


def test_optional_tabs(spark, tmp_path):
    path, good = str(tmp_path / "load"), lambda: spark.createDataFrame([(1, "a")], KEYED)
    bad = lambda: good().withColumn("v", F.raise_error(F.lit("no such column")).cast("string"))
    out = {r["tab"]: (r["status"], r["rows"]) for r in ledger.load_tabs(spark, path, {"links": good, "hosts": good, "burndown": bad}).collect()}
    assert out == {"links": ("ok", 1), "hosts": ("ok", 1), "burndown": ("failed", None)}
    with pytest.raises(Exception, match="no such column"):
        ledger.load_tabs(spark, path, {"links": bad, "hosts": good})
    assert ledger.current(spark, f"{path}/links", KEYED).count() == 1 and ledger.current(spark, f"{path}/hosts", KEYED).count() == 1


def test_refresh_touches_only_new_uploads(spark, sf_dir, tmp_path):
    t, path = Tables(spark, sf_dir), str(tmp_path / "views")
    old = t.uploads.where("not is_active")
    n = refresh.refresh(t.links, old, path)
    files = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.startswith("part-") and "/log" not in d}
    before = files()
    assert n == old.count() and refresh.refresh(t.links, old, path) == 0 and files() == before
    m = refresh.refresh(t.links, t.uploads, path)
    after = files()
    assert m == t.uploads.count() - n and {f: after[f] for f in before} == before
    new = {f for f in after if f not in before}
    active = {r["upload_id"] for r in t.uploads.where("is_active").collect()}
    assert new and all(int(f.split("upload_id=")[1].split("/")[0]) in active for f in new)
    # An upload that is loaded again counts anew; without rows it is empty.
    one = min(active)
    again = t.uploads.withColumn("created_at", F.when(F.col("upload_id") == one, F.lit(datetime.datetime(2030, 1, 1))).otherwise(F.col("created_at")))
    assert refresh.refresh(t.links.where(F.col("upload_id") != one), again, path) == 1
    site = one // 100
    assert refresh.read_view(spark, path, "device_summary", again).where(F.col("site_id") == site).count() == 0
    assert refresh.read_view(spark, path, "device_summary", again).count() > 0


def column(i):
    return (column(i // 26 - 1) if i >= 26 else "") + chr(65 + i % 26)


def write_workbook(path, tabs, shared=True):
    """A small workbook: tabs as {name: rows of texts or None}; every third row's texts stand inline, None is left out."""
    strings: list[str] = []
    head, sheets = '<?xml version="1.0" encoding="UTF-8"?>', []
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    for rows in tabs.values():
        body = []
        for r, row in enumerate(rows):
            cs = []
            for i, v in enumerate(row):
                if v is None:
                    continue
                ref = f'r="{column(i)}{r + 1}"'
                if isinstance(v, (int, float)) and not isinstance(v, bool):
                    cs.append(f"<c {ref}><v>{v}</v></c>")
                elif isinstance(v, bool):
                    cs.append(f'<c {ref} t="b"><v>{int(v)}</v></c>')
                elif r % 3 == 2 or not shared:
                    cs.append(f'<c {ref} t="inlineStr"><is><r><t>{escape(v[:1])}</t></r><r><t xml:space="preserve">{escape(v[1:])}</t></r></is></c>')
                else:
                    strings.append(v)
                    cs.append(f'<c {ref} t="s"><v>{len(strings) - 1}</v></c>')
            if cs:
                body.append(f'<row r="{r + 1}">{"".join(cs)}</row>')
        sheets.append(f"{head}<worksheet {space}><sheetData>{''.join(body)}</sheetData></worksheet>")
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        names = "".join(f'<sheet name="{escape(n)}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, n in enumerate(tabs))
        z.writestr("xl/workbook.xml", f'{head}<workbook {space} xmlns:r="{rel}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i + 1}" Type="{rel}/worksheet" Target="{"/xl/" if i % 2 else ""}worksheets/sheet{i + 1}.xml"/>' for i in range(len(tabs)))
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        if strings:
            z.writestr("xl/sharedStrings.xml", f"{head}<sst {space}>{''.join(f'<si><t>{escape(s)}</t><rPh><t>x</t></rPh></si>' for s in strings)}</sst>")
        for i, s in enumerate(sheets):
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", s)


def test_workbook_equals_its_csv(spark, tmp_path):
    from tests.test_ingest import HEADER, ROWS

    grid = [HEADER.split(","), *[[c or None for c in r.split(",")] for r in ROWS]]
    hosts = [["Hostname", "NETBOX MODEL", "Status", "Role"], ["sw1", "sn4700", "", "spine"], [None, "x", None, None], ["SPARE", "sn4700", "Human Verified", "leaf"]]
    write_workbook(tmp_path / "book.xlsx", {"Cutsheet": grid, "SITE-HOSTS": hosts, "Copy of Cutsheet": grid, "Empty": [], "Notes & more": [[1, 2.5, True, "a<b"], [], [None, None, "c"]]})
    (tmp_path / "sheet.csv").write_text("\n".join([HEADER, *ROWS]) + "\n")
    rows = workbook.read_workbook(spark, str(tmp_path)).cache()
    assert {r["tab"] for r in rows.select("tab").distinct().collect()} == {"Cutsheet", "SITE-HOSTS", "Notes & more"}
    assert "Copy of Cutsheet" in {r["tab"] for r in workbook.read_workbook(spark, str(tmp_path / "book.xlsx"), all_tabs=True).select("tab").distinct().collect()}
    mine, twin = workbook.tab_table(rows, "cutsheet "), readers.read_csv(spark, str(tmp_path / "sheet.csv"))
    assert mine.columns == [*HEADER.split(","), "file", "row_idx"]
    plain = lambda df: [tuple(r) for r in df.orderBy("row_idx").drop("row_idx", "file").collect()]
    assert plain(mine) == plain(twin)
    load = lambda raw: sorted(map(str, ingest.load_links(raw, 1, 101).drop("row_idx", "file").collect()))
    assert load(mine) == load(twin)
    other = {(r["row"], r["col"]): r["value"] for r in workbook.cells_of(rows).where("tab like 'Notes%'").collect()}
    assert other == {(1, 0): "1", (1, 1): "2.5", (1, 2): "TRUE", (1, 3): "a<b", (3, 2): "c"}
    loaded = {r["hostname"]: r for r in ingest.load_hosts(workbook.tab_table(rows, "site-hosts"), "standard_v1", 1, 101, {"sn4700": "SN4700"}).collect()}
    assert sorted(loaded) == ["SPARE", "sw1"] and loaded["sw1"]["model"] == "SN4700"
    assert (loaded["sw1"]["status_normalized"], loaded["SPARE"]["status_normalized"]) == ("", "human_verified")
    links = ingest.load_links(mine, 1, 101)
    hosts = ingest.load_hosts(workbook.tab_table(rows, "site-hosts"), "standard_v1", 1, 101)
    assert [tuple(r) for r in counters.uncabled_hosts(links, hosts).collect()] == [("spare", "sn4700", True)]
    with pytest.raises(ValueError):
        ingest.load_hosts(hosts.drop("hostname"), "standard_v2", 1, 1)


def test_elevation_tabs(spark, tmp_path):
    """Headers in different rows and columns of several tabs, in one job."""
    a = [["plan"], [None, "RU-BASE", None, "Device Name"], [None, 4.0, None, "sw1"], [], [None, None, None, "sw2"], [None, None, "x", None]]
    b = [["NETBOX-DEVICE-TYPE", "DEVICE NAME", "RU-BASE"], ["t1", "gpu", "12"]]
    write_workbook(tmp_path / "book.xlsx", {"ELEV A": a, "ELEV B": b, "Other": b, "ELEV none": [["x"]]})
    got = rack.elevations(workbook.cells_of(workbook.read_workbook(spark, str(tmp_path / "book.xlsx")))).collect()
    assert sorted(map(tuple, got)) == [("A", 3, "4", "sw1", ""), ("A", 5, "", "sw2", ""), ("B", 2, "12", "gpu", "t1")]


def test_context_merges_in_any_order(spark, sf_dir, tmp_path):
    rows = Tables(spark, sf_dir).links.select(F.col("upload_id").cast("string").alias("file_hash"), F.col("id").alias("row_idx"), "section", "status", "status_normalized", *[f"{s}_{c}" for s in "az" for c in ("device", "port", "optic", "model", "loc_cab_ru", "breakout_loc")])
    out = []
    for name, loads in (("one", ["true"]), ("two", ["file_hash > '300'", "file_hash < '250'", "true"])):
        path = str(tmp_path / name)
        added = [context.add_files(spark, path, rows.where(load), 2) for load in loads]
        assert sum(added) == rows.select("file_hash").distinct().count() and context.add_files(spark, path, rows, 2) == 0
        out.append((sorted(map(str, context.merged_counts(spark, path).collect())), sorted(map(str, context.merged_evidence(spark, path, 2).collect()))))
    assert out[0] == out[1] and out[0][0]


def test_top_items(spark):
    counts = spark.createDataFrame([("x", f"i{i:03}", 100 - i) for i in range(50)] + [("y", "a", 1), (None, "b", 2), (None, "c", 1), (None, "d", 1)], "g string, item string, n long")
    rows = context.top_items(counts, ["g"], "item", 2).collect()
    sums = {}
    for r in rows:
        sums.setdefault(r["g"], []).append((r["rank"], r["item"], r["n"], r["items"]))
    assert sorted(sums["x"]) == [(1, "i000", 100, 1), (2, "i001", 99, 1), (3, None, sum(100 - i for i in range(2, 50)), 48)]
    assert sums["y"] == [(1, "a", 1, 1)] and sorted(sums[None])[2] == (3, None, 1, 1)
    plan = context.top_items(counts.repartition(3), ["g"], "item", 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # the bound holds before the shuffle


def test_sorted_csv(spark, tmp_path):
    df = spark.createDataFrame([(f"sw{i % 25}", f"p{i}", i) for i in range(400)], "device string, port string, n int").repartition(5)
    path = str(tmp_path / "out")
    exports.write_sorted_csv(df, path, *exports.by_name("device", "port"), files=4)
    files = sorted(f for f in os.listdir(path) if f.startswith("part-"))
    texts = [(tmp_path / "out" / f).read_text().splitlines() for f in files]
    assert len(files) == 4 and all(t[0] == "device,port,n" for t in texts)
    got = [tuple(line.split(",")) for t in texts for line in t[1:]]
    assert got == sorted(got, key=lambda r: (int(r[0][2:]), int(r[1][1:]))) and len(got) == 400


def test_rack_serials(spark, tmp_path):
    rows = [("R7", "4.0", " s1 ", "b", None), ("R7", "9", "s2", "a", "t"), ("R10", None, None, None, None), ("R8", "1", "x", "x", "x"), (None, "1", "x", "x", "x")]
    df = spark.createDataFrame(rows, "rack string, position string, serial string, name string, asset_tag string")
    exports.write_rack_serials(df, [7, 10], str(tmp_path / "racks"))
    files = sorted(f for f in os.listdir(tmp_path / "racks") if f.startswith("part-"))
    lines = [x for f in files for x in (tmp_path / "racks" / f).read_text().splitlines()[1:]]
    assert lines == ["R7,9,s2,a,t", "R7,4,s1,b,", "R10,0,,,"]


# What had no test.


def test_topology_names(spark):
    texts = ["TIER-1 SPINE", "us-east-01 x leafs", "us-east-01 x", "Section 4", "topology_b", "FDP-TO-SPINE", "gpu pod", "loose note", "a-b", "us-east-rack TORx", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    named = [r[0] for r in df.where(ingest.topology_like(F.col("t"))).collect()]
    assert named == ["TIER-1 SPINE", "us-east-01 x leafs", "us-east-01 x", "Section 4", "topology_b", "FDP-TO-SPINE", "gpu pod", "a-b", "us-east-rack TORx"]
    chain = spark.createDataFrame([("9us-east-01 x leafs",), ("9us-east-01 x",)], "t string")  # no other form fits a leading digit
    assert [r[0] for r in chain.where(ingest.topology_like(F.col("t"))).collect()] == ["9us-east-01 x leafs"]


def test_tabs_without_inventory():
    tabs = ["my backup tab", "COPY_OF_x", "copy of", "sheet12", "sheet1a", "legend", "LEGEND_2", "legends", "Overhead", "overhead 2", "very old", "older", "x archive", "", "golden"]
    assert readers.wanted_tabs(tabs) == ["copy of", "sheet1a", "legends", "overhead 2", "older", "golden"]


def test_activate_latest(spark):
    rows = [(1, 1, 5), (2, 1, 7), (3, 1, 7), (4, 2, 1)]
    out = readers.activate_latest(spark.createDataFrame(rows, "upload_id int, site_id int, created_at int"))
    assert {r["upload_id"] for r in out.where("is_active").collect()} == {3, 4}


def test_new_files(spark, tmp_path):
    for n, text in (("a.csv", "x"), ("b.csv", "y"), ("c.csv", "x")):
        (tmp_path / n).write_text(text)
    found = readers.file_hashes(spark, str(tmp_path))
    assert found.count() == 3 and found.select("file_hash").distinct().count() == 2
    loaded = found.where("path like '%a.csv'")
    assert [r["path"].rpartition("/")[2] for r in readers.new_files(found, loaded).collect()] == ["b.csv"]


def test_burndown(spark):
    rows = [("a", "", " UP ", "4.0"), ("", "nan", "up", "1"), (None, "z", "", "x")]
    out = ingest.load_burndown(spark.createDataFrame(rows, "a_device string, z_device string, link_status string, cutsheet_row string"))
    assert sorted((r["link_status"], r["cutsheet_row"]) for r in out.where("link_status is not null").collect()) == [("up", 4)]
    assert [(r["z_device"], r["cutsheet_row"]) for r in out.where("link_status is null").collect()] == [("z", None)]


def test_cable_types(spark):
    few = spark.createDataFrame([(("MPO", "LC")[i % 2],) for i in range(100)] + [("",)], "cable_id string")
    out = ingest.split_cable_types(few)
    assert {(r["cable_id"], r["cable_type"]) for r in out.collect()} == {("", "MPO"), ("", "LC"), ("", "")}
    many = spark.createDataFrame([(f"C{i}",) for i in range(100)], "cable_id string")
    assert ingest.split_cable_types(many).where("cable_type <> ''").count() == 0


def test_optic_names(spark):
    df = spark.createDataFrame([("QSFP-DD",), ("Transceiver x",), ("copper",), (None,)], "n string")
    assert [r[0] for r in df.where(cells.is_optic_name(F.col("n"))).collect()] == ["QSFP-DD", "Transceiver x"]


SHEET = "row_idx int, status string, status_normalized string, a_device string, a_loc_cab_ru string, a_model string, a_port string, a_optic string, a_breakout_loc string, a_locode string, z_device string, z_loc_cab_ru string, z_model string, z_port string, z_optic string, z_breakout_loc string, z_locode string"


def sheet_row(i, status=None, slug=None, **own):
    base = {k.split()[0]: None for k in SHEET.split(", ")} | {"row_idx": i, "status": status, "status_normalized": slug} | own
    return tuple(base.values())


def test_cabling_states(spark):
    rows = [
        sheet_row(1, "LLDP Passed", "lldp_passed", a_loc_cab_ru="l1", z_loc_cab_ru="l2", z_model="M2"), sheet_row(2, None, "not_run", a_loc_cab_ru="l1", a_model="M1"),
        sheet_row(3, "lldp passed", "lldp_passed", a_loc_cab_ru="l2", a_model="late"), sheet_row(4, "Cable Not Run", "not_run", a_loc_cab_ru="l3", a_model="M3"), sheet_row(5, None, "not_run", z_loc_cab_ru="l4"),
    ]
    got = {(r["state"], r["model"]) for r in counters.cabling_state(spark.createDataFrame(rows, SHEET)).collect()}
    assert got == {("Work in Progress", "Unknown"), ("Fully Cabled", "M2"), ("Not Cabled", "M3")}


def test_devices_in_service(spark):
    """An end without a model says that the location is in service, too."""
    rows = [sheet_row(1, "Human Verified", "human_verified", a_loc_cab_ru="l1"), sheet_row(2, "x", "other", a_loc_cab_ru="l1", a_model="M1", z_loc_cab_ru="l2", z_model="M2")]
    got = {(r["model"], r["in_service"]) for r in counters.sheet_devices(spark.createDataFrame(rows, SHEET)).collect()}
    assert got == {("M1", True), ("M2", False)}


def test_breakouts_without_location(spark):
    """Of breakout ends without a location those of one port are one."""
    end = lambda i, loc, port: sheet_row(i, "x", "other", a_loc_cab_ru=loc, a_port=port, a_optic="OPT", a_breakout_loc="b", a_locode="L")
    rows = [end(1, None, "p1"), end(2, None, "p1"), end(3, None, "p2"), end(4, "l", None), end(5, "l", None)]
    assert [(r["optic"], r["n"]) for r in counters.sheet_optics(spark.createDataFrame(rows, SHEET)).collect()] == [("OPT", 3)]


def test_context_keeps_rows_where_they_are(spark, tmp_path, monkeypatch):
    """However large an engine takes the list of new files for, rows are not shuffled by file, of which there are few."""
    rows = spark.createDataFrame([(f"f{i % 2}", f"r{i}", "s", "x", "x", *["d", "p", f"o{i % 3}", "m", "l", ""] * 2) for i in range(20)], SHEET_ROWS)
    plans, add = {}, context.add_batch

    def kept(spark, path, df, *more):
        plans[path.rpartition("/")[2]] = df._jdf.queryExecution().executedPlan().toString()
        return add(spark, path, df, *more)

    monkeypatch.setattr(context, "add_batch", kept)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        context.add_files(spark, str(tmp_path / "c"), rows, 2)
        merged = context.merged_counts(spark, str(tmp_path / "c"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    for plan in (plans["counts"], plans["evidence"]):
        assert re.search(r"BroadcastHashJoin \[file_hash#\d+\], \[file_hash#\d+\], LeftSemi", plan)
    assert re.search(r"BroadcastHashJoin \[file_hash#\d+, version#\d+L?\]", merged)


def test_context_equal_cells_and_broken_loads(spark, tmp_path, monkeypatch):
    """Equal cells of a file are evidence twice; a file that was added again after a break counts once."""
    path = str(tmp_path / "c")
    rows = spark.createDataFrame([("f1", "r1", "s", "x", "x", *["d", "p", "o", "m", "l", ""] * 2)] * 2, SHEET_ROWS)
    add = context.add_batch

    def breaks(spark, path, *more):
        if path.endswith("/files"):
            raise RuntimeError("broken")
        return add(spark, path, *more)

    monkeypatch.setattr(context, "add_batch", breaks)
    with pytest.raises(RuntimeError):
        context.add_files(spark, path, rows, 5)
    monkeypatch.setattr(context, "add_batch", add)
    assert context.merged_counts(spark, path).count() == 0 and context.add_files(spark, path, rows, 5) == 1
    assert [(r["n"], r["files"]) for r in context.merged_counts(spark, path).where("kind = 'optic'").collect()] == [(4, 1)]
    assert sorted((r["row_idx"], r["place"], r["rank"]) for r in context.merged_evidence(spark, path, 5).collect()) == [("r1", "a_optic", 1), ("r1", "a_optic", 2), ("r1", "z_optic", 3), ("r1", "z_optic", 4)]


SHEET_ROWS = "file_hash string, row_idx string, section string, status string, status_normalized string, " + ", ".join(f"{s}_{c} string" for s in "az" for c in ("device", "port", "optic", "model", "loc_cab_ru", "breakout_loc"))


def test_large_view_is_written_where_it_is_counted(spark, sf_dir, tmp_path):
    """Rows of devices are shuffled once, so that an upload's are not all in one task."""
    t, path = Tables(spark, sf_dir), str(tmp_path / "views")
    was = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled",)}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        refresh.refresh(t.links, t.uploads.where("upload_id = 107"), path)
    finally:
        for c, v in was.items():
            spark.conf.set(c, v)
    files = lambda name: [f for _, _, fs in os.walk(f"{path}/{name}") for f in fs if f.startswith("part-")]
    assert len(files("device_summary")) > 1 and len(files("optic_inventory_combined")) == 1
    got = refresh.read_view(spark, path, "device_summary", t.uploads)
    want = refresh._devices(t.links.where("upload_id = 107")).groupBy("site_id", "device").agg(F.max("model").alias("model"), F.sum("connections").alias("connections"), F.countDistinct("port").alias("ports"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_batch_moves_rows_once(spark, tmp_path):
    """Rows meet the keys that the table has in the shuffle that deals them out, by a column of the key."""
    schema, path = "d string, p string, v int", str(tmp_path / "t")
    rows = lambda ks, v: spark.createDataFrame([(f"d{k % 9}", f"p{k}", v) for k in ks] + [(None, "p", v)], schema).repartition(5)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = ledger.first_rows(rows(range(9), 1).coalesce(2), ["d", "p"], rows(range(3), 0).coalesce(2), ["d"])._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1
        ledger.add_batch(spark, path, rows([*range(60), *range(60)], 2).unionByName(rows(range(30), 1)), ["d", "p"], by=["d"])
        ledger.add_batch(spark, path, rows(range(90), 3), ["d", "p"], by=["d"])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    got = sorted((r["version"], r["d"], r["p"], r["v"]) for r in ledger.current(spark, path, schema).where("d is not null").collect())
    assert got == sorted((1 if k < 60 else 2, f"d{k % 9}", f"p{k}", 1 if k < 30 else 2 if k < 60 else 3) for k in range(90))
    assert [(r["version"], r["v"]) for r in ledger.current(spark, path, schema).where("d is null").orderBy("version").collect()] == [(1, 1), (2, 3)]
    files = ledger.current(spark, path, schema).select("version", "d", F.col("_metadata.file_path").alias("file")).groupBy("version", "d").agg(F.countDistinct("file").alias("n"))
    assert files.where("n > 1").count() == 0
