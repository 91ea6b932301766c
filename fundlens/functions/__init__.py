"""Column-level building blocks; everything stays JVM-side but one Unicode UDF."""
