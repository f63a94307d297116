"""talkmill: Spark-native auditing, curation and evaluation of conversational and labelled text."""
