"""Part of runfold: functions."""
