"""Block-compressed protobuf extracts as a Spark data source: ``spark.read.format("osmpbf")``."""

from terrane.sources.pbf.source import PbfDataSource, register

__all__ = ["PbfDataSource", "register"]
