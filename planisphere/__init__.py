"""Planisphere: control networks, planetary geometry and label translation as Spark plans."""
