"""Readers and writers: evidence tables, requests, responses and job records."""
