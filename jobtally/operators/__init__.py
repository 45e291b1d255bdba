"""DataFrame-to-DataFrame operators; none of them runs a Spark job itself."""
