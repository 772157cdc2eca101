"""Tile encoders and the tileset writer."""
