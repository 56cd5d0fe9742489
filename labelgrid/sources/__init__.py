"""Readers and writers: image folders, OCR responses, text files, label tables."""
