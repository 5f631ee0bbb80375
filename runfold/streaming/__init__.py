"""Part of runfold: streaming."""
