"""Searches and indexes over tables of cells."""
