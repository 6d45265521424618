"""Alerts to the enriched silver table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from skarn.operators import joins as jn


def alert_enriched(
    alerts: DataFrame, telemetry: DataFrame, nodes: DataFrame, events: DataFrame, **options
) -> DataFrame:
    """Telemetry around the alert, attributes of its node, phase of its pod."""
    with_gpu = jn.alert_telemetry_join(alerts, telemetry, **options)
    return jn.k8s_enrich(jn.node_enrich(with_gpu, nodes), events)
