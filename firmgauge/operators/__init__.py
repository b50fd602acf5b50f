"""DataFrame operators over (entity, period, metric) tables."""
