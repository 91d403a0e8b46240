"""Analytics over the metadata, extents and telemetry of a distributed filesystem, as Spark plans."""
