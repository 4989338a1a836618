"""Where rows come from: CSV catalogues, the driver tables, read-only SQL."""
