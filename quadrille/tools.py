"""The session's methods as tools for an agent: plain arguments in, dictionaries out, errors as values."""

from __future__ import annotations

from collections.abc import Callable

from quadrille.session import GraphSession
from quadrille.sparql.engine import DEFAULT_TIMEOUT_MS

SYSTEM_PROMPT = """You answer from a knowledge graph. Search for literals to find the subjects that a question is
about, read around those subjects with SPARQL, and answer from what you have read. Say so when the graph holds nothing."""
DESCRIPTIONS = {
    "search": "Find literals that hold some words, and the subjects and predicates they belong to.",
    "sparql": "Run a SPARQL query, or an update where updates are allowed.",
    "import": "Add RDF text to the graph, or replace the graph by it.",
    "export": "Give the graph as RDF text.",
}


def _safe(f: Callable[..., dict]) -> Callable[..., dict]:
    def call(**args) -> dict:
        try:
            return {"success": True, **f(**args)}
        except Exception as e:
            return {"success": False, "error": str(e)}

    return call


def create_tools(session: GraphSession, allow_updates: bool = True, default_type: str = "text/turtle") -> dict[str, Callable[..., dict]]:
    def search(query: str, top_k: int = 10, **options) -> dict:
        return {"results": [r.asDict() for r in session.search(query, top_k=top_k, **options).limit(top_k).collect()]}

    def sparql(query: str, base_iri: str = "", timeout_ms: int = DEFAULT_TIMEOUT_MS) -> dict:
        if session.engine is None:
            raise RuntimeError("SPARQL engine is not configured.")
        r = session.engine.execute(query, base_iri, timeout_ms, allow_updates)
        if r.kind in ("construct", "describe"):
            from quadrille.operators.store import export_quads

            return {"kind": r.kind, "data": export_quads(r.quads, {"kind": "serialized", "content_type": default_type})["data"]}
        return {"kind": r.kind, "data": None if r.kind == "void" else r.data()}

    def import_(data: str, content_type: str = default_type, mode: str = "merge") -> dict:
        session.import_({"kind": "serialized", "data": data, "content_type": content_type}, mode)
        return {}

    def export(content_type: str = default_type) -> dict:
        return session.export({"kind": "serialized", "content_type": content_type})

    return {"search": _safe(search), "sparql": _safe(sparql), "import": _safe(import_), "export": _safe(export)}
