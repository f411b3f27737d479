"""lodestrand: conversation, document and event analytics as Spark plans."""
