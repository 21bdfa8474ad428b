"""One city at a time: seeded computations whose every step depends on the one before, run as one task a city."""
