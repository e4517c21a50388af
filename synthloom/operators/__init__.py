"""Table operators: links, faults, drift, detectors, dataset store, measurement, inference."""
