"""Types of participation."""

SELLER, BIDDER = 0, 1
