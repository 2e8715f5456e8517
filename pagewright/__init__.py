"""pagewright: media-to-document dataflow and corpus operators on Apache Spark."""
