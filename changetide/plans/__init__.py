"""Plans that chain operators from messages to stored tables."""
