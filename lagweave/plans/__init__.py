"""Test plans: orders of variables and variable pairs."""
