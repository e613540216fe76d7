"""Sources, sinks and the catalog of datasets."""
