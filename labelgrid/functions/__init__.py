"""Column functions: label codecs, geometry, text, repeatable uniforms."""
