"""Data-quality gating, drift detection and model monitoring as lazy Spark plans."""
