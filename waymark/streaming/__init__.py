"""No operators: nothing here is defined over unbounded input.  Tracks are finite files, and what looks like a stream elsewhere is bounded I/O at a time (sources/fetch.py)."""
