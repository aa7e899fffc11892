"""Words as the near-duplicate and leak searches define them."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Longest runs of letters and digits, in lower case.

    The runs are found before lower-casing, as a lower-cased letter may gain a
    combining mark that would cut its word in two.
    """
    found = WORD.findall(text)
    return "\n".join(found).lower().split("\n") if found else []
