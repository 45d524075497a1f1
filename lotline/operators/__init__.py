"""Operators on auctions, bids and participations."""
