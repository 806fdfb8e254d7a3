"""Readers and writers of mesh, field and configuration text formats."""
