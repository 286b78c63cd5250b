"""Registered queries and their checking SQL."""


def all_queries() -> dict:
    from roadpulse.catalog import answers, history, models, scenes

    return {k: v for m in (history, answers, models, scenes) for k, v in m.QUERIES.items()}


def all_oracles() -> dict:
    from roadpulse.catalog import answers, history, models, scenes

    return {k: v for m in (history, answers, models, scenes) for k, v in m.ORACLE.items()}
