"""Readers: batch files, event lines, stored tables and collector documents."""
