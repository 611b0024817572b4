"""Column functions: name matching, paths, patterns, routes, diffs."""
