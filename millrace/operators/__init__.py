"""Operators over conversions: pages, audio, images, recognition, history, export."""
