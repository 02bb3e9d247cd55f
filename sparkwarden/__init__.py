"""Security analytics over text, source code, manifests and captured HTTP responses, as Spark plans."""
