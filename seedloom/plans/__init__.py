"""From a schema to DataFrames: resolution, graph, fill and presets."""
