"""Shared plan shapes: durable cuts, ordered windows without hot groups, skew-safe joins."""
