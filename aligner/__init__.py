"""Aligner: entity resolution and terminology alignment as Spark DataFrame transforms."""
