"""Operators for training-data pipelines on text, chats, URLs and embeddings."""

from __future__ import annotations


def load():
    """All registered queries of this subpackage and their SQL, by name."""
    from rowmill.llm import queries  # noqa: F401  registers them
    from rowmill.llm.registry import ORACLES, QUERIES

    return dict(QUERIES), dict(ORACLES)
