"""Operators for building training corpora: joins, filters, encoders and file formats over documents."""
