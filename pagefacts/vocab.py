"""Fixed names: vocabularies, status values, and the deployment-specific prefixes.

Everything a deployment must be able to change (knowledge-graph address, prefix
of minted ids, origin marks) is a field of :class:`Vocabulary`; operators take it
as a parameter.
"""

from __future__ import annotations

from dataclasses import dataclass

SCHEMA = "http://schema.org/"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
XSD_DATETIME = "http://www.w3.org/2001/XMLSchema#dateTime"
XSD_DATE = "http://www.w3.org/2001/XMLSchema#date"

# The five review states, and the two in which a value may be published.
STATUSES = ("initial", "missing", "ok", "problem", "updated")
REVIEWED = ("ok", "updated")

# Group names of hand-made links, and the marker of a failed extraction.
ADDED = "Manually added"
DELETED = "Manually deleted"
ABORT = "abort_update"


@dataclass(frozen=True)
class Vocabulary:
    kg_prefix: str = "adr:"
    kg_base: str = "http://kg.example.org/resource/"
    mint_prefix: str = "mint:"
    mint_base: str = "http://kg.example.org/minted/"
    ontology_base: str = "http://kg.example.org/ontology/"
    origin_refresh: str = "refresh"
    origin_create: str = "create"

    @property
    def kg_entity(self) -> str:
        """Start of the URIs the knowledge graph itself maintains."""
        return self.kg_base + "K"


DEFAULT = Vocabulary()
