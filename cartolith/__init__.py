"""Curation of labelled geospatial asset datasets on Spark."""
