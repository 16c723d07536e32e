"""cladeforge: a PySpark-native analytics engine for clustering divergent nucleotide sequences."""
