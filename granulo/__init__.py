"""Analytics for populations of circular particles on microscope images, as DataFrame operations keyed by data set."""
