"""Operations of a large training-data pipeline, one module for each; nothing else in the library imports this."""
