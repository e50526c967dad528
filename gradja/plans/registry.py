"""Every query of the core by name, and its SQL."""

from __future__ import annotations

from gradja.plans import aggregates, evaluation, fileforms, modelling, relational, scalars, sourcing  # noqa: F401
from gradja.plans.base import QUERIES, SQL  # noqa: F401
