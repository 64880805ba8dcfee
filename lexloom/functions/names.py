"""Case names in plain Python, for folds that compare names one by one; the columns of citations.py give the same."""

from __future__ import annotations

import re

# Words that don't tell parties apart.
DROPPED = re.compile(r"\b(?:in\s+re|ex\s+rel\.?|the)\b")
CORPORATE = re.compile(r"\b(?:company|co|corporation|corp|incorporated|inc|limited|ltd)\b")


def key(name: str) -> str:
    name = CORPORATE.sub(" ", DROPPED.sub(" ", name.lower()))
    return re.sub("[^a-z0-9]+", " ", re.sub(r"\bversus\b", " v ", name)).strip()


def tokens(name: str) -> set[str]:
    return {w for w in key(name).split() if w != "v" and len(w) > 1}


def compatible(a: str, b: str) -> bool:
    """As citations.names_compatible()."""
    x, y, p, q = key(a), key(b), tokens(a), tokens(b)
    return x in y or y in x or (len(p & q) >= 2 and len(p & q) / max(len(p), len(q)) >= 0.5)
