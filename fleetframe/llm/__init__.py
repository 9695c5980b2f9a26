"""Operators for training data: packing, mixing, de-duplication, quality, search and scans."""
