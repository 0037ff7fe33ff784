"""Everything that planning can refuse."""


class MetricsError(ValueError):
    """Base of all errors of this package."""


class UnknownTable(MetricsError):
    def __init__(self, name: str, providers=()):
        super().__init__(f"no table {name!r}; providers: {', '.join(providers) or 'none'}")


class AmbiguousTable(MetricsError):
    def __init__(self, name: str, providers):
        super().__init__(f"table {name!r} is in several providers; write one of {', '.join(f'{p}:{name}' for p in providers)}")


class UnknownColumn(MetricsError):
    pass


class AmbiguousColumn(MetricsError):
    pass


class BadReference(MetricsError):
    pass


class NoJoinPath(MetricsError):
    pass


class FanOut(MetricsError):
    """A dimension is reached over a to-many relation, which would count rows of the measure several times."""


class BadGranularity(MetricsError):
    pass


class DuplicateAlias(MetricsError):
    pass


class MixedConnections(MetricsError):
    pass


class UnknownAggregate(MetricsError):
    pass
