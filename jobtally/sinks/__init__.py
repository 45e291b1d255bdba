"""Writers for every format the sources read, and the multi-sink fan-out."""
