"""Readers of particle files, images, settings and working directories."""
