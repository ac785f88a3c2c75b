"""What an English question names: values that become parameters of a query. Plain text work on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# Words that point to a subject.
SUBJECTS = {
    "diff": "diff difference differences changed changes delta compare comparison versus vs added removed modified",
    "upload": "upload uploads version versions revision revisions history",
    "sites": "across sites cross-site every-site",
    "burndown": "burndown neighbor neighbors",
    "lldp": "lldp",
    "mismatch": "mismatch mismatches mismatched wrong unexpected differ differs",
    "fail": "fail failed failing failure failures error errors issue issues",
    "role": "role roles",
    "rack": "rack racks cabinet cabinets",
    "optic": "optic optics transceiver transceivers sfp qsfp qsfp28 qsfp-dd",
    "cable": "cable cables cabling fiber fibers",
    "media": "media type types",
    "status": "status state health progress verified verification passed pending terminated",
    "section": "section sections tier tiers topology",
    "done": "complete completed completion incomplete percentage percent rate",
    "trend": "trend trends trending progression trajectory timeline historical improving worsening",
    "hall": "hall halls",
    "overview": "overview site stats",
    "node": "node nodes compute gpu gpus server servers",
    "device": "device devices switch switches router routers",
    "link": "connection connections link links connected",
    "model": "model models",
    "ip": "ip subnet vrf",
}
_WORDS = {w: s for s, ws in SUBJECTS.items() for w in ws.split()}
ROLES = ("fdp", "cdu", "pdu", "tor", "ups", "spine", "leaf", "fabric", "patch")
STATUS_PHRASES = {
    "in service": ("lldp_passed", "human_verified", "complete"),
    "lldp passed": ("lldp_passed",), "lldp failed": ("lldp_failed",), "human verified": ("human_verified",),
    "not terminated": ("not_terminated",), "not run": ("not_run",), "pending": ("pending",), "in progress": ("in_progress",),
}


@dataclass
class Question:
    text: str
    subjects: set[str] = field(default_factory=set)
    device: str = ""
    location: str = ""
    optic: str = ""
    section: str = ""
    model: str = ""
    statuses: tuple[str, ...] = ()
    role: str = ""
    side: str = ""
    ip: str = ""
    cable_type: str = ""
    uploads: tuple[int, ...] = ()


def _first(pattern: str, text: str) -> str:
    found = re.search(pattern, text, re.I)
    return next((g for g in found.groups() if g), "") if found else ""


def location(text: str) -> str:
    """hall:rack:ru, hall:rack or hall, the rack padded to three digits; a bare rack is :rack."""
    full = re.search(r"\b(dh\d+:\d+(?::\d+)?)\b", text, re.I)
    if full:
        h, r, *u = full[1].lower().split(":")
        return ":".join([h, r.zfill(3), *u])
    name = re.search(r"\b(?:data\s+hall\s+|dh\s?)(\d+)\b", text, re.I)
    rack = re.search(r"\brack\s+(\d+)\b", text, re.I) or re.search(r"\bdh\d+\s+(\d+)\b", text, re.I)
    where = f"dh{name[1]}" if name else ""
    return f"{where}:{rack[1].zfill(3)}" if rack else where


def read(text: str) -> Question:
    low = text.lower()
    words = re.findall(r"[a-z0-9][a-z0-9+\-]*", low)
    q = Question(text, {_WORDS[w] for w in words if w in _WORDS})
    q.location = location(text)
    q.ip = _first(r"\b(\d{1,3}(?:\.\d{1,3}){1,3})\b", text)
    q.optic = _first(r"\b(o?q?sfp[\w\-+]+)\b", text).upper()
    q.cable_type = _first(r"\b(mpo\d*|smf|mmf|lc|cat6a?)\b", text).upper()
    q.model = _first(r"\bmodel\s+([\w\-]*\d[\w\-]*)|\b((?:sn|pa|cm|om|ptx|r)-?\d{3,}[\w\-]*)\b|\b(brand#\d+)", text)
    q.model = re.sub(r"(?<=\d)s$", "", q.model)
    named = re.search(r"\b([a-z]+\d*-[a-z0-9\-]*\d[a-z0-9\-]*)\b", low)
    if named and named[1].upper() not in (q.optic, q.model.upper()) and not re.match(r"(?:a|z)-side|dh\d", named[1]):
        q.device = named[1]
    tier = _first(r"\b(tier[\s\-]?\d+(?:\s*(?:-|to)\s*\d+)?)\b", text)
    q.section = tier or _first(r"\b(?!(?:which|what|each|every|by|per|the|this|that|a)\b)([\w\-]+)\s+section\b|\bsection\s+(?!(?:has|have|is|summary|completion|status|by)\b)([\w\-]+)", text)
    q.role = next((r for r in ROLES if re.search(rf"\b{r}s?\b", low)), "")
    q.side = "A" if re.search(r"\ba[\s\-]?sides?\b", low) else "Z" if re.search(r"\bz[\s\-]?sides?\b", low) else ""
    q.statuses = next((s for p, s in STATUS_PHRASES.items() if p in low), ())
    pair = re.search(r"\b(?:uploads?|versions?)?\s*#?(\d+)\s*(?:and|to|vs\.?|versus|with)\s*(?:upload|version)?\s*#?(\d+)\b", low)
    q.uploads = (int(pair[1]), int(pair[2])) if pair and "diff" in q.subjects else ()
    return q
