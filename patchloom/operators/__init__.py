"""Table operators built from DataFrame joins, groupings and bounded windows."""
