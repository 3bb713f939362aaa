"""Operations of a training-data pipeline over text, vectors and web pages."""
