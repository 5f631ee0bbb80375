"""Part of runfold: operators."""
