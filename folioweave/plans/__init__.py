"""Plans over the graph: path patterns, pages and feeds, format conversion."""
