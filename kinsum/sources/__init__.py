"""Input tables: declared schemas, loaders, lookups (SRC1-SRC3, FLT3)."""

from kinsum.sources.crm import Sources

__all__ = ["Sources"]
