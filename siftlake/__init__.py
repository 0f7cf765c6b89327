"""Siftlake: data reduction (kernels, coresets, discrepancies) on Spark DataFrames."""
