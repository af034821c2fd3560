"""Jobs that run by themselves: a command line, a config file, and a function that takes a session."""
