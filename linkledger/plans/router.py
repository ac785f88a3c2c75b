"""From a question to a bound query: the first rule that applies names the query and its parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from linkledger.functions.cells import CABLE_RUN, VERIFICATION
from linkledger.functions.question import Question, read
from linkledger.operators import inventory

from .fixture import Tables


@dataclass
class Bound:
    name: str
    params: dict = field(default_factory=dict)
    confidence: str = "high"

    def run(self, t: Tables) -> DataFrame:
        return getattr(inventory, self.name)(t, **self.params)


def model_query(q: Question) -> Bound:
    low = q.text.lower()
    if q.statuses:
        return Bound("model_status_count", {"model": q.model, "statuses": q.statuses})
    if "unique" in low or "distinct" in low:
        return Bound("model_unique_count", {"model": q.model})
    if "how many" in low or "count" in low:
        return Bound("model_raw_count", {"model": q.model, "data_hall": q.location.split(":")[0]})
    return Bound("model_list", {"model": q.model, "data_hall": q.location.split(":")[0]})


def route(text: str, site_id: int | None = None, upload_id: int | None = None) -> Bound:
    q, has = read(text), read(text).subjects.__contains__
    at = {"site_id": site_id, "upload_id": upload_id}

    def bind(name: str, scoped: bool = True, confidence: str = "high", **params) -> Bound:
        return Bound(name, (at if scoped else {}) | params, confidence)

    if has("diff") and (has("upload") or q.uploads) and not has("trend"):
        return bind("upload_diff", False, old=q.uploads[0], new=q.uploads[1]) if q.uploads else bind("upload_list", False, "low", site_id=site_id or 0)
    if has("upload") and not has("trend"):
        return bind("upload_list", False, site_id=site_id or 0)
    if has("sites"):
        return bind("cross_site_optics" if has("optic") else "cross_site_status" if has("status") or has("done") else "cross_site_models", False)
    if has("burndown") or has("mismatch"):
        return bind("neighbor_mismatch" if has("mismatch") or "neighbor" in q.text.lower() else "link_status")
    if has("lldp") and not has("trend") and not q.model:
        return bind("lldp_failures") if has("fail") else bind("status_of", slugs=VERIFICATION)
    if has("role") and not has("optic"):
        return bind("role_lookup", role=q.role, side=q.side, device=q.device)
    if q.location and not has("optic"):
        if q.model:
            bound = model_query(q)
            return Bound(bound.name, at | bound.params)
        if has("rack") and not q.location.count(":") and "summary" in q.text.lower():
            return bind("rack_summary")
        return bind("location_lookup", location=q.location) if ":" in q.location else bind("data_hall_summary", hall_prefix=q.location)
    if has("rack"):
        return bind("rack_summary")
    if has("cable") and has("media") or q.cable_type:
        return bind("cable_type_summary")
    if has("optic") or q.optic:
        return bind("optic_count", optic=q.optic, section=q.section, location=q.location)
    if has("trend"):
        return bind("trend_section", False, site_id=site_id or 0, section=q.section) if has("section") else bind("trend_status", False, site_id=site_id or 0)
    if q.model:
        bound = model_query(q)
        return Bound(bound.name, at | bound.params)
    if has("section"):
        return bind("section_completion" if has("done") or has("status") else "section_summary")
    if has("status") or has("done") or has("cable"):
        verified = any(w in q.text.lower() for w in ("verif", "passed"))
        return bind("status_of", slugs=VERIFICATION if verified else CABLE_RUN)
    if has("hall"):
        return bind("data_hall_summary")
    if has("overview"):
        return bind("site_overview")
    if has("node"):
        return bind("node_compute")
    if q.ip:
        return bind("raw_search", text=q.ip)
    if q.device:
        return bind("device_connections", device=q.device) if has("link") else bind("device_list", device=q.device, limit=None)
    if has("device"):
        return bind("side_device_list", side=q.side.lower()) if q.side else bind("device_list")
    return bind("general", confidence="low")


def as_text(bound: Bound, df: DataFrame, most: int = 200) -> str:
    """Rows as compact text; a listing that was cut says so."""
    rows = df.take(most + 1)
    if not rows:
        return f"{bound.name}: nothing found"
    lines = [", ".join(f"{k}={v}" for k, v in r.asDict().items() if v is not None) for r in rows[:most]]
    return "\n".join([f"{bound.name}:", *lines, *(["..."] if len(rows) > most else [])])
