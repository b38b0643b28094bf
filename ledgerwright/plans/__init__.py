"""The data products: staging, fact, dimensions, marts, datasets and their checks."""
