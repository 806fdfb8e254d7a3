"""Runnable jobs: each is a function of a session and paths, and a command line around it."""
