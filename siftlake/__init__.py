"""Siftlake: label-free selection of anomaly detectors, and the data work around it, as Spark plans."""
