"""Operations of a training-data pipeline, each usable alone."""
