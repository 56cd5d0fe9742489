"""All registered queries; importing a module registers its queries."""

from labelgrid.plans import q_agreement, q_classes, q_jobs, q_metrics, q_monitor, q_pixels, q_sampling, q_sources, q_spatial, q_text  # noqa: F401
from labelgrid.plans.registry import ORACLES, QUERIES  # noqa: F401
