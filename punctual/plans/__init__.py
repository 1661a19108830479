"""Write policies and the build order of the analysis tables."""
