"""Point clouds, skeleton graphs and text corpora as DataFrame programs."""
