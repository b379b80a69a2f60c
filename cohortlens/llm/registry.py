"""The operators' queries by name, and the SQL that checks them."""

from __future__ import annotations

from cohortlens.llm import (crossparse, mixing, nearcopies, neighbours, packing, ppm, prefixtrie, quality, rules,
                            secrets, spelling, toxicity, wordpiece)

MODULES = [packing, ppm, quality, toxicity, rules, secrets, nearcopies, neighbours, mixing, wordpiece, crossparse,
           prefixtrie, spelling]

QUERIES = {q.__name__: q for m in MODULES for q in m.QUERIES}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
