"""DataFrame operators: shapes, blocks, matching, merging, parameters, scores."""
