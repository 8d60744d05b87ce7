"""Named queries over the driver's tables. Importing this package registers all of them."""

from lodestone.plans import answers, associations, catalog, compilation, curation, evaluation, evidence, graph, jobs, origins, planning, ranking, reading, review, structure  # noqa: F401
from lodestone.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
