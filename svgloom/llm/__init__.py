"""Operations of a training-data pipeline at cluster scale. Nothing else in the library imports this subpackage."""
