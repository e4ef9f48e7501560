"""From a configuration to a plan: compiled for nested columns, or a tree for each parsed document."""
