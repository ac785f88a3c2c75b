import pytest

from linkledger.functions.question import location, read
from linkledger.plans.fixture import Tables
from linkledger.plans.router import as_text, route

CASES = {
    "Which section has the best completion percentage?": "section_completion",
    "Give me a section summary": "section_summary",
    "How many optics are there?": "optic_count",
    "How many QSFP-DD-400 are pending?": "optic_count",
    "Show the LLDP failures": "lldp_failures",
    "What is the LLDP status?": "status_of",
    "Are there neighbor mismatches?": "neighbor_mismatch",
    "What is the burndown link status?": "link_status",
    "What changed between uploads 104 and 105?": "upload_diff",
    "List uploads": "upload_list",
    "Compare optics across all sites": "cross_site_optics",
    "Is the trend improving?": "trend_status",
    "Show the completion trend by section": "trend_section",
    "Which racks have the most connections?": "rack_summary",
    "What is in dh202 rack 41?": "location_lookup",
    "Devices in data hall 202": "data_hall_summary",
    "What cable types are used?": "cable_type_summary",
    "List z-side devices": "side_device_list",
    "Connections of leaf-07": "device_connections",
    "List all devices": "device_list",
    "How many SN4700s are in service?": "model_status_count",
    "Which roles are on the A side?": "role_lookup",
    "Site overview": "site_overview",
    "hello": "general",
}


@pytest.mark.parametrize("text", CASES)
def test_route(text):
    assert route(text).name == CASES[text]


def test_values():
    assert location("dh202 rack 7") == "dh202:007" and location("rack 12") == ":012" and location("DH202:41:35") == "dh202:041:35"
    assert read("SN4700s in service").model == "SN4700" and read("SN4700s in service").statuses[0] == "lldp_passed"
    assert read("diff uploads 104 to 105").uploads == (104, 105)


def test_run(spark, sf_dir):
    t = Tables(spark, sf_dir)
    b = route("Which section has the best completion percentage?")
    assert "pct=" in as_text(b, b.run(t))
