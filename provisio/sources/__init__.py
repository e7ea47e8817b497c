"""Sources and sinks: landing of production/claims files, dimension files,
Parquet sink, fingerprints, completeness gate, adapter views over the driver
tables."""
