"""Vigilog: forensics over coding-agent activity records, as Spark jobs.

Facts are captured once into the event row; every interpretation is a pure
DataFrame function of events that can be recomputed at any time.
"""
