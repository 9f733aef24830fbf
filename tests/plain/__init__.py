"""The coders in plain Python, as the tests hold the JVM's against them."""
