"""The comparison scanners, as the SQL of their acceptance."""

from __future__ import annotations

from sievework.functions.dialect import Spark
from sievework.functions.tables import SMALL_BYTES, SMALL_EXTENSIONS, SMALL_TYPES, UPLOAD_BYTES, UPLOAD_EXTENSIONS, UPLOAD_TYPES
from sievework.operators.layers import listed


SNIFFED = ("FFD8FF", "89504E470D0A1A0A", "47494638", "424D")  # what the header check takes for an image


def _parts(d: Spark) -> tuple[str, str, str, str]:
    last = f"CASE WHEN contains(file_name, '.') THEN lower({d.rx_extract('file_name', r'[.]([^.]*)$')}) ELSE '' END"
    begins = "startswith" if d.name == "spark" else "starts_with"
    image = "(" + " OR ".join(f"{begins}(head, '{x}')" for x in SNIFFED) + ")"
    return f"{last} IN {listed(SMALL_EXTENSIONS)}", f"lower(declared_type) IN {listed(SMALL_TYPES)}", f"size_bytes < {SMALL_BYTES}", image


def comparators(d: Spark) -> dict[str, str]:
    """Scanner name: SQL of its acceptance, over a file's measures. That which rewrites is not among them."""
    named, typed, small, image = _parts(d)
    return {
        "DVWA-Low": "true",
        "DVWA-Medium": f"{typed} AND {small}",
        "DVWA-High": f"{named} AND {small} AND {image}",
        "BasicValidation": f"size_bytes BETWEEN 1 AND {UPLOAD_BYTES} AND ext IN {listed(UPLOAD_EXTENSIONS)} AND lower(declared_type) IN {listed(UPLOAD_TYPES)}",
    }


def reencodable(d: Spark) -> str:
    """Whether a file reaches the re-encoding of the scanner that rewrites."""
    return "coalesce(" + " AND ".join(_parts(d)) + ", false)"
