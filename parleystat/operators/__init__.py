"""DataFrame operators: skew-safe joins and scans, survey frames, regression, chat turns."""
