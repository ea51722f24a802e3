"""Text transforms around retrieval: query specifications, cards, prompts, answers."""
