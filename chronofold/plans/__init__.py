"""Typed feature programs and evaluation folds."""
