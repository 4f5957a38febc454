"""DataFrame -> DataFrame jobs.  All are lazy unless their docstring says otherwise."""
