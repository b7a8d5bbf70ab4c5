"""folioflow.streaming: enrichment of arriving images, each asked once."""
