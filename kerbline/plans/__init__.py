"""Entry points composed of operators."""
