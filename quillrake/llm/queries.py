"""Catalogue of this subpackage's queries and their SQL."""

from __future__ import annotations

from . import checks, containers, languages, lookalikes, mixture, reading_level, seen_keys, truncation

QUERIES = {
    "p1_found": languages.p1_found,
    "p1_segments": languages.p1_segments,
    "p3_found": lookalikes.p3_found,
    "p3_forms": lookalikes.p3_forms,
    "p4_found": seen_keys.p4_found,
    "p4_errors": seen_keys.p4_errors,
    "p4_counts": seen_keys.p4_counts,
    "p7_found": truncation.p7_found,
    "p7_shares": truncation.p7_shares,
    "p8_assignments": containers.p8_assignments,
    "p8_fill": containers.p8_fill,
    "p9_mixture": mixture.p9_mixture,
    "p9_shares": mixture.p9_shares,
    "p10_found": reading_level.p10_found,
    "p10_levels": reading_level.p10_levels,
    **checks.QUERIES,
}

ORACLES = {"p4_found": seen_keys.P4_SQL, "p4_counts": seen_keys.P4_COUNTS_SQL, **checks.ORACLES}
