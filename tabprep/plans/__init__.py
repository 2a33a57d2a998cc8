"""Chains of steps, the standard six-step preparation, and the auto-deciding steps."""
