"""Training-data operators.  Nothing else in the package imports this subpackage."""


def queries() -> dict:
    """Their queries by name."""
    from textloom.llm import registry

    return registry.queries()


def oracles() -> dict[str, str]:
    """SQL for the queries that SQL can express."""
    from textloom.llm import registry

    return registry.oracles()
