"""Monthly panel analytics on Spark: densify, impute, derive features, find anomalies."""

from paneltide.spec import PanelSpec

__all__ = ["PanelSpec"]
