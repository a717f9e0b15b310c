"""Where files, commits, configurations and patterns come from."""
