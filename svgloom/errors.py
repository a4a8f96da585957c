"""What can be wrong with a row. In tables these are values of an ``error`` column, not exceptions that end a job."""


class RowError(ValueError):
    """Base of all faults that belong to one row."""

    kind = "row"


class SvgQualityError(RowError):
    kind = "quality"


class TextLabelError(RowError):
    kind = "label"


class CorruptionError(RowError):
    kind = "corruption"


class SvgExtractionError(RowError):
    kind = "extraction"
