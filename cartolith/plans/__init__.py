"""The queries of the library; importing the modules registers them."""

from cartolith.plans import curation, evidence, records, scores, splits, stores, tiling, trips  # noqa: F401
from cartolith.plans.queries import QUERIES, SQL  # noqa: F401
