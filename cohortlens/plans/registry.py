"""All registered queries by name, and the SQL that checks them."""

from __future__ import annotations

from cohortlens.plans import (composition, evaluation, loading, modelling, signals,
                              splitting)

MODULES = [composition, loading, splitting, evaluation, signals, modelling]

QUERIES = {q.__name__: q for m in MODULES for q in m.QUERIES}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
