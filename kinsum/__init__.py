"""kinsum: per-contact rollups (donations, soft credits, related-contact giving,
events, grants, mailings) computed as Spark DataFrame jobs.

Entry points:

* :class:`RollupConfig` - every filter list and the reference date.
* :class:`Sources` - the CRM-shaped input tables.
* :mod:`kinsum.operators` - one builder per metric family.
* :func:`refresh` - fused wide table of all active metrics; :func:`metric` - one metric.
* :func:`upsert` - keyed column patch; :class:`Store` - the wide table and its state in contact buckets.
* :mod:`kinsum.streaming.incremental` - change feeds -> affected contacts -> patch.
"""

from kinsum.config import RollupConfig
from kinsum.plans.refresh import metric, public, refresh
from kinsum.plans.registry import Registry, RollupSpec, default_registry
from kinsum.plans.store import Store
from kinsum.plans.upsert import upsert
from kinsum.sources.crm import Sources

__all__ = [
    "RollupConfig",
    "Registry",
    "RollupSpec",
    "Sources",
    "Store",
    "default_registry",
    "metric",
    "public",
    "refresh",
    "upsert",
]
