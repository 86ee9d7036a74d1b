"""Metric families.  Each module exposes ``KEYS`` and ``build(src, cfg, keys)``
returning ``DataFrame[entity_id, <key>...]`` with one row per contact of the
family's population (SURVEY §2.9), computed in one fused plan per family."""
