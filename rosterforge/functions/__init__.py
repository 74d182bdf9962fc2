"""Column functions; all but those that say otherwise stay in the JVM."""
