"""Chainsieve: wallet and token analytics as Spark DataFrame operators."""
