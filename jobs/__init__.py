"""Runnable jobs over the engine's operators: each a function of a session and its settings, and a command line around it."""
