"""Parcel damage analytics on Spark: queries over land parcels, before/after pixels, structures and scenes."""
