"""Tactile: text, layout, frames and capture sessions as Spark DataFrame operators."""
