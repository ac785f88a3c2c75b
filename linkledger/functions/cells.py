"""Cell and key helpers: column expressions only."""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Status slugs and their families.
IN_SERVICE = ("lldp_passed", "human_verified", "complete")
FAILED = ("lldp_failed",)
PENDING = ("not_run", "not_terminated", "pending", "in_progress", "addition")
VERIFICATION = ("lldp_passed", "lldp_failed", "human_verified")
CABLE_RUN = ("complete", "not_terminated", "not_run", "addition", "in_progress", "pending")
# How each status is written in sheets, in lower case, and how it is displayed.
SPELLINGS = {
    "complete": ("cable is ran: complete", "cable is ran complete", "cable is ran:complete", "cable is ran - complete", "cable ran complete", "cable complete", "complete"),
    "not_terminated": ("cable is ran: not terminated", "cable is ran not terminated", "cable is ran:not terminated", "cable is ran - not terminated", "not terminated", "not_terminated"),
    "not_run": (
        "cable not run", "cable not ran", "no cable", "cable not run: priority", "cable not run:priority", "cable not run - priority",
        "no label & not yet run", "no label and not yet run", "not_run", "not_run_priority",
    ),
    "addition": ("addition",),
    "human_verified": ("human verified", "human: verified", "manually verified", "human_verified"),
    "lldp_passed": ("lldp passed", "lldp: passed", "lldp:  passed", "lldp:passed", "lldp - passed", "lldp_passed"),
    "lldp_failed": ("lldp failed", "lldp: failed", "lldp:  failed", "lldp:failed", "lldp - failed", "lldp_failed"),
    "in_progress": ("in progress", "in_progress"),
    "pending": ("pending",),
}
DISPLAYED = {
    "complete": "Cable Is Ran Complete",
    "not_terminated": "Cable Is Ran Not Terminated",
    "not_run": "Cable Not Run",
    "addition": "Addition",
    "human_verified": "Human Verified",
    "lldp_passed": "LLDP Passed",
    "lldp_failed": "LLDP Failed",
    "in_progress": "In Progress",
    "pending": "Pending",
}
SLUGS = {text: slug for slug, texts in SPELLINGS.items() for text in texts}


def literal_map(entries: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(entries.items())])


def present(c: Column | str) -> Column:
    """Not missing: null, the empty string and the literal nan all mean missing."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~c.isin("", "nan")


def clean_cell(c: Column | str) -> Column:
    """Trimmed text, or null for any of the wider set of missing marks."""
    c = F.trim(F.col(c) if isinstance(c, str) else c)
    return F.when(~F.lower(c).isin("", "nan", "-", "none", "null"), c)


def family(c: Column | str, slugs: tuple[str, ...]) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).isin(*slugs), F.lit(False))


def status_slug(c: Column | str) -> Column:
    """Slug of a status as displayed: blank is not_run, unknown is other."""
    text = F.lower(F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))))
    return F.when(text.isin("", "nan"), "not_run").otherwise(F.coalesce(F.try_element_at(literal_map(SLUGS), text), F.lit("other")))


def display_status(c: Column | str) -> Column:
    """A status as it is displayed, however the sheet writes it; unknown ones as they are, blank ones and nan as empty."""
    text = F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    shown = literal_map({text: DISPLAYED[slug] for text, slug in SLUGS.items()})
    return F.when(F.lower(text) == "nan", "").otherwise(F.coalesce(F.try_element_at(shown, F.lower(text)), text))


def replaced(c: Column, own: dict[str, str] | None) -> Column:
    """Values that a site writes in its own way, in any case, by what they stand for."""
    return F.coalesce(F.try_element_at(literal_map({k.lower(): v for k, v in own.items()}), F.lower(c)), c) if own else c


def model_name(c: Column, aliases: dict[str, str]) -> Column:
    """Alias of a model; else of the model without a revision suffix; else as given."""
    names = literal_map({k.lower(): v for k, v in aliases.items()})
    low = F.lower(F.trim(c))
    bare = F.regexp_replace(low, r"[-_]\s*(?:rev[a-z0-9]*|v\d+|r\d+)$", "")
    return F.coalesce(F.try_element_at(names, low), F.try_element_at(names, bare), F.trim(c))


def safe_cell(c: Column, most: int = 200) -> Column:
    """Text that no spreadsheet takes for a formula."""
    return F.substring(F.regexp_replace(F.trim(c), r"^[=+\-@\s]+", ""), 1, most)


def at_location(loc: Column | str, where: str) -> Column:
    """Whether a hall:rack:unit cell lies where a question points: at a unit, in a rack of a hall, in a hall (dh20 is not
    dh201), in a rack of any hall; other text may stand anywhere in the cell. Empty text is nowhere. Zeros before a rack
    number don't count; a cell may end with its rack."""
    cell = F.lower(F.col(loc) if isinstance(loc, str) else loc)
    place = where.strip().lower().removeprefix(":")
    named = re.fullmatch(r"([a-z]{1,4}\d+)?(?:(?:^|:)(\d{1,4}))?(:\d+)?", place)
    if not place:
        return F.lit(False)
    if not named or named[3] and not (named[1] and named[2]):
        return cell.contains(place)
    if named[3]:
        return cell == place
    rack = f"0*{int(named[2])}" if named[2] else "[^:]*"
    return cell.rlike(f"^{named[1] or '[^:]*'}:{rack}(:|$)") if named[2] else cell.startswith(f"{named[1]}:")


def hall(loc: Column | str) -> Column:
    return F.split_part(F.col(loc) if isinstance(loc, str) else loc, F.lit(":"), F.lit(1))


def rack_key(loc: Column | str) -> Column:
    """hall:rack with the rack padded to three digits."""
    loc = F.col(loc) if isinstance(loc, str) else loc
    rack = F.split_part(loc, F.lit(":"), F.lit(2))
    return F.when(present(loc) & (rack != ""), F.concat(hall(loc), F.lit(":"), F.lpad(rack, 3, "0")))


def rack_number(loc: Column | str) -> Column:
    """Rack text without leading zeros, as the rack analyzer compares it."""
    loc = F.col(loc) if isinstance(loc, str) else loc
    return F.regexp_replace(F.split_part(loc, F.lit(":"), F.lit(2)), r"^0+(?=.)", "")


def natural_key(c: Column | str) -> Column:
    """Sort key in which runs of digits compare as numbers."""
    c = F.lower(F.col(c) if isinstance(c, str) else c)
    return F.regexp_replace(F.regexp_replace(c, r"(\d+)", "0000000000$1"), r"\d*(\d{10})(?!\d)", "$1")


def escape_like(text: str) -> str:
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.round(F.lit(100.0) * part / F.nullif(whole, F.lit(0)), digits).cast("double")


def enum_name(slug: Column, aliases: dict[str, str] | None = None) -> Column:
    """TYPE_ name of an interface slug."""
    own = F.concat(F.lit("TYPE_"), F.upper(F.replace(F.trim(slug), F.lit("-"), F.lit("_"))))
    return F.coalesce(F.try_element_at(literal_map(aliases), F.lower(F.trim(slug))), own) if aliases else own


def is_optic_name(c: Column) -> Column:
    return c.rlike("(?i)sfp|osfp|transceiver|xcvr|optic")
