"""Human-readable sizes, as given for size-bounded output."""

from __future__ import annotations

import re

# Unit letters and their power of 1024.
UNIT_POWERS = {"": 0, "K": 1, "M": 2, "G": 3, "T": 4, "P": 5}


def parse_size(text: str) -> int:
    """Bytes in ``100M``, ``1.5g`` or ``1024``; other text is an error."""
    match = re.fullmatch(r"\s*(\d+\.?\d*|\.\d+)([A-Za-z]?)\s*", text)
    if match is None or match[2].upper() not in UNIT_POWERS:
        raise ValueError(f"not a size: {text!r}")
    return int(float(match[1]) * 1024 ** UNIT_POWERS[match[2].upper()])
