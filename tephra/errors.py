"""Refusals that are part of the semantics."""


class EngineError(Exception):
    """Base of all refusals."""


class SourceError(EngineError):
    """A source could not be fetched or lacks what it must have."""


class ColumnError(SourceError):
    """A required column is missing."""


class AcquisitionError(EngineError):
    """Fetching observations failed."""


class AuthenticationError(AcquisitionError):
    """A source let nobody in."""


class GriddingError(EngineError):
    """Grids are absent, unequal or empty after a clip."""


class IncompleteCubeError(GriddingError):
    """Too few of the expected periods are there."""


class GeometryError(EngineError):
    """No facilities, or an empty footprint or ring."""


class TrendError(EngineError):
    """A trend fit would be degenerate."""


class InsufficientDataError(EngineError):
    """Too few observations for a decomposition."""


class AlignmentError(EngineError):
    """No predictor or target column."""


class InsufficientOverlapError(EngineError):
    """Two series share too few periods."""


class InsufficientEventsError(EngineError):
    """Too few events for a study."""


class MarketDataError(EngineError):
    """No prices, or no benchmark among them."""


class UnknownStrategyError(EngineError, ValueError):
    """A strategy name that isn't registered."""

    def __init__(self, kind: str, name: str, known):
        super().__init__(f"unknown {kind} {name!r}; known: {', '.join(sorted(known))}")
