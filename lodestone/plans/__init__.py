"""Planning and building of tile trees."""
