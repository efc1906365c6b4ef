"""quern: corpus analytics and retrieval expressed as Spark plans."""
