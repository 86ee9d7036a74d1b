"""Fused batch refresh (SNK2, X5): every active metric in one wide table.

Each family is computed once for all of its active keys (a single
conditional aggregation per source table; the contribution, related and soft
families share theirs, and the donations are read twice: by contact, and by the
soft credits' donation id).  Every family output is one row per contact and is
already hash-partitioned on the contact by its own aggregation.  The
assembly is ``UNION ALL`` of the family outputs + ``groupBy(entity_id)`` with
``max`` per column: with ``spark.sql.unionOutputPartitioning`` (on by default
in Spark 4) the union keeps that partitioning, so the assembly adds no
shuffle and no family is computed twice.  A column a family does not produce
is NULL in its rows and ``max`` ignores NULL, so each metric keeps exactly its
own value (NULL included) and its own population.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsum.config import RollupConfig
from kinsum.operators import contributions, related, soft
from kinsum.plans.registry import Registry, default_registry
from kinsum.sources.crm import Sources

log = logging.getLogger(__name__)


@dataclass
class RefreshReport:
    computed: list[str] = field(default_factory=list)
    skipped: dict[str, str] = field(default_factory=dict)
    as_of: str = ""
    ok: bool = True
    # of the written table: its rows, and how many have a value of each metric
    rows: int | None = None
    filled: dict[str, int] = field(default_factory=dict)


def metric(
    src: Sources, cfg: RollupConfig, key: str, registry: Registry | None = None, population: str = "trigger_table"
) -> DataFrame:
    """One metric alone: ``DataFrame[entity_id, key]``.

    POP1: ``population="trigger_table"`` gives the metric's own population
    (contacts found in its source table); ``"all"`` gives every contact of any
    active metric's population, NULL where the metric has no row (the rows the
    wide table holds for it)."""
    reg = registry or default_registry()
    spec = reg.specs[key]
    own = reg.families[spec.family](src, cfg, [key])
    if population == "trigger_table":
        return own
    if population != "all":
        raise ValueError("population must be 'trigger_table' or 'all'")
    keys = [s.key for s in reg.select(cfg.active)]
    frames = family_frames(src, cfg, reg, keys)
    ids = frames[0].select("entity_id")
    for f in frames[1:]:
        ids = ids.unionAll(f.select("entity_id"))
    return ids.distinct().join(own, "entity_id", "left")


def flag(family: str) -> str:
    """Hidden column of the stored table: the contact is in ``family``'s population."""
    return f"_in_{family}"


def _fusible(registry: Registry, families: dict) -> bool:
    """Several readers of the donations, with the library's own families."""
    if registry.families.get("contributions") is not contributions.build or registry.families.get("soft") is not soft.build:
        return False
    keys = families.get("contributions", [])
    readers = [any(k in related.KEYS for k in keys), "hard_and_soft" in keys, "soft" in families]
    known = all(k in contributions.KEYS or k in related.KEYS for k in keys) and all(k in soft.KEYS for k in families.get("soft", []))
    return known and (readers[0] or (readers[1] and readers[2]))


def family_frames(
    src: Sources,
    cfg: RollupConfig,
    registry: Registry,
    keys=None,
    contacts=None,
    membership: bool = False,
    skipped: dict | None = None,
) -> list[DataFrame]:
    """One frame per family.  With a ``skipped`` dict, a metric whose plan cannot be
    built (bad user metric, missing column or lookup) is left out and reported there,
    and the others of its family are computed (X3); without it the error propagates."""

    def built(build, fkeys):
        f = build(src, cfg, fkeys, contacts=contacts)
        missing = [k for k in ["entity_id", *fkeys] if k not in f.columns]
        if missing:
            raise ValueError(f"no column {missing}")
        return f

    frames = []
    families = registry.by_family(keys)
    if contacts is None and _fusible(registry, families):
        try:
            ckeys, skeys = families["contributions"], families.get("soft", [])
            f = contributions.fused(src, cfg, ckeys, skeys)
            kept = [flag(fam) for fam in ("contributions", "soft") if fam in families] if membership else []
            frames.append(f.select("entity_id", *ckeys, *skeys, *kept))
            families = {fam: ks for fam, ks in families.items() if fam not in ("contributions", "soft")}
        except Exception as e:  # noqa: BLE001 - the families are tried one by one, which tells the metric
            if skipped is None:
                raise
            log.warning("families are computed one by one: %s", e)
    for fam, fkeys in families.items():
        build = registry.families[fam]
        try:
            f = built(build, fkeys)
        except Exception as whole:  # noqa: BLE001 - reported, the other metrics continue
            if skipped is None:
                raise
            good = []
            for k in fkeys:
                try:
                    if len(fkeys) == 1:
                        raise whole
                    built(build, [k])
                    good.append(k)
                except Exception as e:  # noqa: BLE001
                    log.warning("skipping metric %s: %s", k, e)
                    skipped[k] = f"{type(e).__name__}: {e}"
            if not good:
                continue
            f = built(build, good)
        frames.append(f.withColumn(flag(fam), F.lit(True)) if membership else f)
    return frames


def wide(frames: list[DataFrame], keys: list[str], labels: dict | None = None, flags=()) -> DataFrame:
    """Assemble family outputs; ``labels`` become column comments (PRJ3);
    ``flags`` are carried as population-membership booleans (False if absent)."""
    labels = labels or {}
    u = frames[0]
    for f in frames[1:]:
        u = u.unionByName(f, allowMissingColumns=True)
    return u.groupBy("entity_id").agg(
        *[F.max(k).alias(k, metadata={"comment": labels[k]} if k in labels else None) for k in keys],
        *[F.coalesce(F.max(c), F.lit(False)).alias(c) for c in flags],
    )


def refresh(
    src: Sources,
    cfg: RollupConfig,
    registry: Registry | None = None,
    keys=None,
    contacts: DataFrame | None = None,
    membership: bool = False,
) -> tuple[DataFrame | None, RefreshReport]:
    """Wide table of the active metrics; with ``contacts`` only those contacts'
    rows are computed (the incremental path), each from its own base rows.
    ``membership=True`` adds the hidden ``_in_<family>`` population flags that
    the stored table of the incremental path keeps."""
    reg = registry or default_registry()
    keys = keys if keys is not None else cfg.active
    specs = reg.select(keys)
    report = RefreshReport(as_of=cfg.as_of.isoformat(), skipped=dict(reg.skipped))
    if not specs:
        report.ok = False
        return None, report
    requested = [s.key for s in specs]
    frames = family_frames(src, cfg, reg, requested, contacts, membership, report.skipped)
    active = [k for k in requested if k not in report.skipped]
    # a wrong path or a lost table must not look like an empty one
    lost = [k for k in requested if "required table" in report.skipped.get(k, "")]
    if lost or not frames:
        report.ok = False
        return None, report
    report.computed = active
    flags = [flag(f) for f in reg.by_family(active)] if membership else []
    return wide(frames, active, {s.key: s.label for s in specs}, flags), report


def public(stored: DataFrame) -> DataFrame:
    """The stored table without its hidden membership flags."""
    return stored.select([c for c in stored.columns if not c.startswith("_in_")])
