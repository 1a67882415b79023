"""Where cells come from and where they are kept."""
