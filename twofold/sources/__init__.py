"""Tables in, artifacts in and out."""
