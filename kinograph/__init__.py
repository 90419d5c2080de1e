"""kinograph: temporal, media-timeline and signal analytics as Spark DataFrame operators."""
