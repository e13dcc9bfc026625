"""Readers and writers for map, timetable and track formats."""
