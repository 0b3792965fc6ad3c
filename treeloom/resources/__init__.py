"""Templates that come with the library."""
