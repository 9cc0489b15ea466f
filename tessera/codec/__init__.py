"""Bit-serial parts of the image format: header parsing, entropy decoding, block transforms on arrays, an encoder."""
