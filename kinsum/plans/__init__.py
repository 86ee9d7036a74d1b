"""Plans over the metric families: registry, fused refresh, upsert,
affected-contact derivation for incremental maintenance."""
