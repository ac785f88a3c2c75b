import pytest
from pyspark.sql import functions as F

from linkledger.functions import cells
from linkledger.operators import counters, ingest, rack
from linkledger.sources import readers

HEADER = "STATUS,A-SIDE-DNS-NAME,A-SIDE PORT,A-PORT,A-OPTIC,A-MODEL,A-LOC:CAB:RU,A-SIDE LOCODE,Z-SIDE-DNS-NAME,Z-PORT,Z-OPTIC,Z-MODEL,Z-LOC:CAB:RU,Z-SIDE LOCODE,CABLE ID"
ROWS = [
    "TIER-1 SPINE,,,,,,,,,,,,,,",
    "Cable Is Ran: Complete,sw1,e1,x,OPT-A,sn4700,dh202:041:01,L1,sw2,p1,OPT-B,SN2201,dh202:7:02,L2,C1",
    "Human Verified,sw1,,e2,OPT-A,sn4700-rev2,dh202:041:01,L1,sw3,p1,nan,SN2201,dh203:8:02,L2,C2",
    "GPU LEAF,,,,,,,,,,,,,,",
    "Cable Not Run,sw4,e1,,OPT-C,SN3700,dh202:042:01,L1,sw2,p2,OPT-B,SN2201,dh202:7:02,L2,C3",
    "Cable Not Run,sw4,e1,,OPT-C,SN3700,dh202:042:01,L1,sw2,p2,OPT-B,SN2201,dh202:7:02,L2,C3",
    "Odd,sw5,e9,,OPT-C,SN3700,dh202:043:01,L1,sw2,p9,OPT-B,SN2201,dh202:7:02,L2,C4",
]


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    p = tmp_path_factory.mktemp("csv") / "sheet.csv"
    p.write_text("\n".join([HEADER, *ROWS]) + "\n")
    return readers.read_csv(spark, str(p))


@pytest.fixture(scope="module")
def links(raw):
    return ingest.load_links(raw, 1, 101, {"sn4700": "SN4700"}).cache()


def test_layouts():
    assert ingest.detect_layout(HEADER.split(",")) == "standard_v1"
    assert ingest.detect_layout(["Source Device", "Dest Device", "cable number"]) == "alternate"
    assert ingest.detect_layout(["x"]) is None


def test_load(links):
    rows = {r["cable_id"]: r for r in links.collect()}
    assert sorted(rows) == ["C1", "C2", "C3", "C4"]
    assert [rows[c]["section"] for c in ("C1", "C3")] == ["TIER-1 SPINE", "GPU LEAF"]
    assert rows["C2"]["a_port"] == "e2" and rows["C2"]["a_model"] == "SN4700"
    assert [rows[c]["status_normalized"] for c in ("C1", "C2", "C3", "C4")] == ["complete", "human_verified", "not_run", "other"]


def test_missing_columns(spark):
    df = spark.createDataFrame([("a", "b", "c")], "`Source Device` string, `Dest Device` string, `Cable Number` string")
    with pytest.raises(ValueError):
        ingest.canonical(df, "alternate")


def test_tabs():
    assert readers.wanted_tabs(["Copy of A", "Sheet3", "Main", "old stuff", "LEGEND-1"]) == ["Main"]
    assert readers.pick_tab(["Main", "cutsheet_clean", "CUTSHEET"]) == "cutsheet_clean"
    assert readers.has_link_columns(["A-OPTIC", "A-PORT"]) and not readers.has_link_columns(["A-OPTIC"])


def test_insert_new_and_json(spark, links):
    assert ingest.insert_new(links, links.limit(0), ["cable_id"]).count() == 4
    assert ingest.insert_new(links, links.where("cable_id = 'C1'"), ["cable_id"]).count() == 3
    j = spark.createDataFrame([("x", "nan", None)], "a string, b string, c string").select(ingest.raw_json(["a", "b", "c"]).alias("j")).first()["j"]
    assert j == '{"a":"x"}'


def test_roles(spark, links):
    hosts = spark.createDataFrame([(101, " SW1", "spine"), (101, "sw1", "core"), (102, "sw4", "leaf")], "upload_id int, hostname string, role string")
    rows = {r["cable_id"]: r for r in ingest.with_roles(links, hosts).collect()}
    assert rows["C1"]["a_role"] == "core" and rows["C3"]["a_role"] is None and len(rows) == 4


def test_counters(links):
    n = {(r["optic"], r["in_service"]): r["n"] for r in counters.sheet_optics(links, by="service").collect()}
    assert n == {("OPT-A", True): 2, ("OPT-B", True): 1, ("OPT-C", False): 2, ("OPT-B", False): 2}
    assert {r["optic"]: r["n"] for r in counters.optic_cells(links).collect()} == {"OPT-A": 2, "OPT-B": 3, "OPT-C": 2}
    assert {r["optic"]: (r["a"], r["z"]) for r in counters.mpo_optics(links).collect()} == {"OPT-A": (2, 0), "OPT-B": (0, 3), "OPT-C": (2, 0)}
    state = {(r["state"], r["model"]): r["n"] for r in counters.cabling_state(links).collect()}
    assert state[("Not Cabled", "SN3700")] == 1 and state[("Work in Progress", "SN4700")] == 1
    assert sum(r["n"] for r in counters.sheet_devices(links).collect()) == 5
    assert counters.top_locations(links, 1).where("rank > 1").count() == 0


def test_rack(spark, links):
    assert rack.resolve_room(links, "dh203") == "dh203"
    with pytest.raises(ValueError):
        rack.resolve_room(links, "dh2")
    hosts = spark.createDataFrame([("sw9", "m", "dh202:41")], "hostname string, model string, rack string")
    rows = {r["device"]: r["state"] for r in rack.rack_devices(links, "dh202", "041", hosts).collect()}
    assert rows == {"sw1": "Installed", "sw9": "Listed"}
    assert {r["optic"]: r["n"] for r in rack.rack_optics(links, "dh202", "41").collect()} == {"OPT-A": 2}
    cells_ = spark.createDataFrame([(1, 1, "41"), (2, 1, "GPU"), (1, 2, "42"), (2, 2, "RES-1")], "row int, col int, value string")
    assert [tuple(r) for r in rack.overhead_types(cells_).collect()] == [("41", "GPU")]


def test_cells(spark):
    df = spark.createDataFrame([("=+cmd", "dh1:7:2", "sw10"), ("ok", "x", "sw9")], "a string, b string, c string")
    assert [r[0] for r in df.select(cells.safe_cell(F.col("a"))).collect()] == ["cmd", "ok"]
    assert [r[0] for r in df.select(cells.rack_key("b")).collect()] == ["dh1:007", None]
    assert [r["c"] for r in df.orderBy(cells.natural_key("c")).collect()] == ["sw9", "sw10"]
    assert df.select(cells.enum_name(F.lit("100gbase-x"))).first()[0] == "TYPE_100GBASE_X"
    assert cells.escape_like("a_b%") == "a\\_b\\%"


def test_row_filter(links):
    assert ingest.row_filter(links, [("and", "a_device", "eq", "sw1"), ("or", "a_device", "eq", "sw5"), ("and", "none", "eq", "x")]).count() == 3


def test_sheets_stay_apart(links):
    """Two uploads with the same keys: each is counted as its own sheet, as if the other were not there."""
    two, per = links.unionByName(links.withColumn("upload_id", F.lit(102))), ("upload_id",)
    runs = [counters.sheet_optics, counters.optic_cells, counters.mpo_optics, counters.sheet_devices, counters.cabling_state, counters.model_index, counters.top_locations, counters.device_registry, lambda df, **k: rack.rack_optics(df, "dh202", "41", **k), lambda df, **k: rack.rack_devices(df, "dh202", "41", **k)]
    for run in runs:
        one = sorted(map(str, run(links).collect()))
        rows = run(two, per=per)
        for upload in (101, 102):
            assert sorted(map(str, rows.where(F.col("upload_id") == upload).drop("upload_id").collect())) == one


def test_every_upload_is_counted(spark, sf_dir):
    from linkledger.plans import registry, sheets  # noqa: F401
    from linkledger.plans.fixture import Tables

    uploads = {r["upload_id"] for r in Tables(spark, sf_dir).links.select("upload_id").distinct().collect()}
    assert len(uploads) > 1 and {r["upload_id"] for r in registry.QUERIES["every_sheet_optics"](spark, sf_dir).collect()} == uploads


def test_write_upload_diff(spark, sf_dir, tmp_path):
    """Every change is a row of its own, in the folder of its kind."""
    from linkledger.operators import inventory
    from linkledger.plans.fixture import Tables

    t, path = Tables(spark, sf_dir), str(tmp_path / "diff")
    inventory.write_upload_diff(t, 104, 105, path)
    want = inventory.upload_diff_rows(t, 104, 105)
    got = spark.read.parquet(path).select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 0
    assert {p.name for p in (tmp_path / "diff").glob("change=*")} == {f"change={r['change']}" for r in inventory.upload_diff(t, 104, 105).collect()}


def test_at_location(spark):
    rows = ["dh20:041:1", "dh20:41:35", "dh201:041:1", "DH20:7:2", "dh20:0410:1", "dh20:41", None, ""]
    df = spark.createDataFrame([(r,) for r in rows], "loc string")
    found = lambda where: {r.loc for r in df.where(cells.at_location("loc", where)).collect()}
    assert found("dh20") == {"dh20:041:1", "dh20:41:35", "DH20:7:2", "dh20:0410:1", "dh20:41"}
    assert found("DH20:41") == {"dh20:041:1", "dh20:41:35", "dh20:41"}
    assert found("041") == found(":041") == {"dh20:041:1", "dh20:41:35", "dh201:041:1", "dh20:41"}
    assert found("dh20:41:35") == {"dh20:41:35"}
    assert found("") == set() and found("0:1") == {"dh20:0410:1"}


def test_live_devices(spark):
    df = spark.createDataFrame([("active", "4.0"), ("provisioned", "x"), ("planned", "1"), (None, None)], "status string, position string")
    assert {(r.status, r.position) for r in ingest.live_devices(df).collect()} == {("active", 4), ("provisioned", None)}


def test_views_stale(spark):
    ups = spark.createDataFrame([(5,)], "created_at int")
    none = spark.createDataFrame([], "refreshed_at int")
    stale = lambda u, r: ingest.views_stale(u, r).first().stale
    assert stale(ups, none) and not stale(ups.limit(0), none) and not stale(ups, spark.createDataFrame([(5,)], "refreshed_at int"))


def test_settled(spark):
    rows = [("LLDP:  passed", "sn4700-rev2", " OPT "), ("cable not run - PRIORITY", "x", "NaN"), ("Done by us", "Y", None), (None, None, ""), (" nan ", "", "o"), ("Odd", "z", "o")]
    df = spark.createDataFrame(rows, "status string, a_model string, a_optic string")
    got = ingest.settled(df, {"sn4700": "SN4700"}, {"done BY us": "Human Verified"}, {"sn4700": "Switch", "y": "Why"}).withColumn("slug", cells.status_slug("status"))
    assert [tuple(r) for r in got.collect()] == [
        ("LLDP Passed", "Switch", "OPT", "lldp_passed"), ("Cable Not Run", "x", "", "not_run"), ("Human Verified", "Why", "", "human_verified"), ("", None, "", "not_run"), ("", "", "o", "not_run"), ("Odd", "z", "o", "other"),
    ]


def test_every_spelling_has_its_slug(spark):
    df = spark.createDataFrame([(k.upper(), v) for k, v in cells.SLUGS.items()] + [(v, k) for k, v in cells.DISPLAYED.items()], "status string, slug string")
    assert df.where(cells.status_slug("status") != F.col("slug")).count() == 0
    assert df.where(cells.status_slug(cells.display_status("status")) != F.col("slug")).count() == 0


def test_link_records(spark):
    cols = "row_idx int, a_device string, a_loc_cab_ru string, a_port string, a_breakout_loc string, z_device string, z_loc_cab_ru string, z_breakout_loc string"
    rows = [
        (1, "d", "l", "p", "b", "z", None, ""), (2, "d", "l", "p", "b2", "z", None, "b"), (3, "d", "l", "p", "", "z", None, None), (4, "d", "l", "q", "b", "", "", ""),
        (5, "nan", None, None, "b", "z", "", ""), (6, "", "", "p", "b", None, "nan", ""), (7, None, "m", "nan", "b", None, None, None), (8, None, "m", None, "b", None, None, None),
    ]
    got = {r["row_idx"]: (r["a_breakout"], r["z_breakout"], r["a_breakout_new_optic"]) for r in counters.link_records(spark.createDataFrame(rows, cols)).collect()}
    assert got == {1: (True, False, True), 2: (True, True, False), 3: (False, False, True), 4: (True, False, True), 5: (True, False, True), 7: (True, False, True), 8: (True, False, False)}


def test_registry_of_unnamed_devices(spark):
    rows = [("s", "nan", "M", "l1", "Dev", None, ""), ("t", None, "M", "l1", "", "x", "nan")]
    df = spark.createDataFrame(rows, "section string, a_device string, a_model string, a_loc_cab_ru string, z_device string, z_model string, z_loc_cab_ru string")
    got = {(r["device"], r["loc_cab_ru"], r["model"]): (r["sections"], r["sides"], r["n"]) for r in counters.device_registry(df).collect()}
    assert got == {("", "l1", "M"): (["s", "t"], ["A"], 2), ("dev", "", ""): (["s"], ["Z"], 1)}


def test_trend_of_uploads_without_links(spark, sf_dir):
    """An upload without links is a row of its own; a section that is asked for leaves it out."""
    from linkledger.operators import inventory
    from linkledger.plans.fixture import Tables

    t = Tables(spark, sf_dir)
    t.links = t.links.where("upload_id <> 103")
    bare = [r for r in inventory.trend_section(t, 1).collect() if r["upload_id"] == 103]
    assert [(r["section"], r["total"], r["completed"], r["lldp_passed"], r["pct"]) for r in bare] == [(None, 1, 0, 0, 0.0)]
    assert 103 not in {r["upload_id"] for r in inventory.trend_section(t, 1, "machin").collect()}
    assert [r["total"] for r in inventory.trend_status(t, 1).collect() if r["upload_id"] == 103] == [1]


def test_links_table_follows_its_sources(spark, sf_dir, tmp_path):
    """A changed source or a cleared table gives a new table; else the same is read again."""
    import shutil

    from linkledger.plans import fixture

    own = str(tmp_path / "sf")
    shutil.copytree(sf_dir, own)
    n, path = fixture.Tables(spark, own).links.count(), lambda: fixture._WRITTEN[spark.sparkContext.applicationId, own][1]
    first = path()
    assert fixture.Tables(spark, own).links.count() == n and path() == first
    few = fixture.Tables(spark, sf_dir).read("lineitem").limit(100).toPandas()
    few.to_parquet(f"{own}/lineitem.parquet", coerce_timestamps="us")
    assert 0 < fixture.Tables(spark, own).links.count() <= 100 and path() != first
    second, m = path(), fixture.Tables(spark, own).links.count()
    shutil.move(second, str(tmp_path / "gone"))
    assert fixture.Tables(spark, own).links.count() == m and path() != second


def test_links_table_moves_numbers(spark, sf_dir):
    """Rows are dealt out once as they are written, as numbers: neither ids nor places nor statuses are shuffled or stored."""
    from linkledger.plans import fixture

    t = fixture.Tables(spark, sf_dir)
    kept = t.raw_links.groupBy("upload_id", "a_device", "a_port", "z_device", "z_port").agg(F.min("id").alias("id")).select("id")
    links = t.links
    stored = set(spark.read.parquet(fixture._WRITTEN[spark.sparkContext.applicationId, sf_dir][1]).columns)
    assert not stored & {"id", "status", "a_loc_cab_ru", "z_loc_cab_ru", "cable_id", "a_port", "z_device"}
    assert kept.exceptAll(links.select("id")).count() == links.select("id").exceptAll(kept).count() == 0
    plan = t.first_facts(3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(upload_id") == 1 and "REBALANCE" not in plan and "hashpartitioning(upload_id#" in plan
    spread = t.first_facts(3).select("upload_id", "a_device", F.spark_partition_id().alias("p")).groupBy("upload_id", "a_device").agg(F.countDistinct("p").alias("n"))
    assert spread.where("n > 1").count() == 0


def test_physical_links_in_one_pass(spark):
    """Rows without any port field are all kept, also those that share a number, and rows are read once."""
    rows = [(1, "d", "p", None, "", 2), (1, "d", "p", None, "", 1), (1, "", "nan", None, "", 3), (1, "", "nan", None, "", 3), (2, "d", "p", None, "", 9)]
    df = spark.createDataFrame(rows, "upload_id int, a_device string, a_port string, z_device string, z_port string, row_idx int")
    got = ingest.physical_links(df)
    assert sorted((r["upload_id"], r["row_idx"]) for r in got.collect()) == [(1, 1), (1, 3), (1, 3), (2, 9)] and got.columns == df.columns
    assert "Union" not in got._jdf.queryExecution().executedPlan().toString()


def test_sorted_ends_hold_flags(spark, sf_dir):
    """What the first sort of ends by location holds: flags in place of statuses."""
    import re

    from linkledger.plans.sheets import every, roce_sheet
    from linkledger.plans.fixture import Tables

    t = Tables(spark, sf_dir)
    for df in (counters.cabling_state(every(t), ("upload_id",)), counters.first_models(every(t), ("upload_id",)), counters.roce_devices(roce_sheet(t), ("upload_id",))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        held = re.findall(r"SortAggregate\(key=.*?functions=\[(.*?)\]\)?\n", plan)
        assert held and not any("status" in x or "shown" in x for x in held), plan
