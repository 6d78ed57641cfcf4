"""Listing feeds on Spark: snapshots in, outbox of cards and counts out."""

from listingloom.session import prepare

__all__ = ["prepare"]
