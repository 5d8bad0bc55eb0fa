"""Readers, fixed-cadence binning and sinks."""
