"""DataFrame operators on regions: joins, set algebra, expansion."""
