"""Inputs and outputs: listing pages, day layouts, watched trees, sample payloads, sinks."""
