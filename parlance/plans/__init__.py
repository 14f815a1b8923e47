"""Registered queries over the test tables, with SQL that must give the same rows."""


def everything() -> dict:
    """name -> (query, oracle SQL or None)."""
    from parlance.plans import speech, texts, work

    return {**speech.QUERIES, **texts.QUERIES, **work.QUERIES}
