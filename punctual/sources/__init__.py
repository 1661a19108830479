"""Readers and writers: static schedules, realtime messages, web logs, fixtures."""
