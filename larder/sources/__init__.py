"""Application descriptors and the documents their file associations route."""
