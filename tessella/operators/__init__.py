"""DataFrame operators on palettes, pixels, frames and byte streams."""
