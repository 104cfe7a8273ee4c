"""Scheduled and streaming alert scans, and an event-time extension."""
