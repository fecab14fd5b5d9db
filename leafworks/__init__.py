"""Leafworks: publishing-catalogue, translation-quality and text-corpus analytics as Spark DataFrame operators."""
