"""Cyber-physical risk analytics as Spark DataFrame and streaming operators."""
