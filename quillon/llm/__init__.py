"""Operations of a training-data pipeline over the documents, pages and benchmark tables."""
