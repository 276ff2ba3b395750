"""The weekly profile over a stream of decisions."""
