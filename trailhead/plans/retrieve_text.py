"""Texts that plans and their SQL share."""

RULE = "=" * 80
THIN = "-" * 80
QUESTION = "How does the heating of the nation and the thand onther that reer move through erthtion?"
CITED = "It moves there [node:{}]."
UNCITED = "It moves there [node:does-not-exist] [node:does-not-exist]."
