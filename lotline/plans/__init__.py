"""Plans that keep state between runs."""
