"""Range inference over ordered action logs, expressed as Spark DataFrames."""
