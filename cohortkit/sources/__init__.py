"""Sources and sinks: driver tables, fixture views, catalog, dataset files."""
