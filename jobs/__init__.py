"""Jobs: a function that takes a session and plain paths, a command line and a small config file each."""
