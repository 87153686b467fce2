"""Readers and decoders that turn raw inputs into typed DataFrames."""
