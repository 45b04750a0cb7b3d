"""The same operators over streams, in micro-batches."""
