"""lodestone: document analytics and retrieval expressed as Spark plans."""
