"""Types, predicates, aggregates, sketches and logical codecs as DataFrame functions."""
