"""Part of runfold: sources."""
