"""Names of the training-data queries; most have no SQL and are tested against brute force or a round trip."""

from __future__ import annotations

from skarn.llm.boilerplate import p7_found
from skarn.llm.garbled import p10_found, p10_restored
from skarn.llm.mapping import p3_found, p3_misses
from skarn.llm.matching import p2_found, p2_groups
from skarn.llm.packing import p9_bins, p9_certificate
from skarn.llm.residue import p5_found
from skarn.llm.surviving import p6_found, p6_survivors
from skarn.llm.tokens import p8_ids, p8_restored


def queries() -> dict:
    return {"p2_found": p2_found, "p2_groups": p2_groups, "p3_found": p3_found, "p3_misses": p3_misses, "p5_found": p5_found, "p7_found": p7_found, "p6_found": p6_found, "p6_survivors": p6_survivors, "p8_ids": p8_ids, "p8_restored": p8_restored, "p9_bins": p9_bins, "p9_certificate": p9_certificate, "p10_found": p10_found, "p10_restored": p10_restored}


def oracle_sql() -> dict[str, str]:
    return {}
