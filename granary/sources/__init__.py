"""Sources: file discovery, header inventory, CSV scans, samples, matrix bundles."""
