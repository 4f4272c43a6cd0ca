"""All registered queries of the package, with the SQL that says the same."""

from __future__ import annotations

from loomwright.plans import customers, models, neighbors, series, text  # noqa: F401
from loomwright.plans.catalog import QUERIES, SQL  # noqa: F401

FLAGSHIP = "phrase_weights_top100"
