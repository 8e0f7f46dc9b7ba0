"""Readers that map the supplied tables to the canonical ones, and writers of snapshots and models."""
