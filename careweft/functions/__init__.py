"""Column functions: no scans, no shuffles."""
