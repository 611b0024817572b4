"""Error classes of graph queries."""


class GraphQueryError(Exception):
    """Anything wrong with a graph query."""


class ParserError(GraphQueryError):
    """The text isn't a query."""


class BinderError(GraphQueryError):
    """A name, type or place that doesn't fit; raised before anything runs."""


class RuntimeQueryError(GraphQueryError):
    """A value that an operation can't take."""


class UnsupportedError(GraphQueryError):
    """A part of the language that is left out on purpose."""
