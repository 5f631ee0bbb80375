"""Part of runfold: plans."""
