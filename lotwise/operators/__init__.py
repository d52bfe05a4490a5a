"""Operators over DataFrames: parcels, zones, neighbourhoods, change, structures, roll-up, scenes, accuracy, rendering."""
