"""Names, enumerations and schemas of the engine's tables."""

from __future__ import annotations

#: Fixed values, in the order of their stored indices.
DEGREES = ("Facilitate", "Enable", "Disentail", "Inhibit")
CAUSAL_TYPES = ("Consequence", "Motivation", "Purpose", "Inference")
OVERLAPPING_TYPES = ("Temporal", "Correlation", "Hypothetical", "Obligation_permission", "Creation_termination", "Extremity_sufficiency", "Context")
NER_TYPES = ("Person", "Organization", "Location", "O")
#: Degrees that binarisation joins with another.
BINARY_DEGREES = {"Enable": "Facilitate", "Disentail": "Inhibit"}
#: Edge labels that don't count for depth.
NOT_FOR_DEPTH = ("ref",)

TOKEN = "struct<idx:int,text:string,lower:string,lemma:string,pos:string,gen_pos:string,start:int,end:int>"
EDGE = "struct<head:int,dep:int,label:string>"
NODE = "struct<node:int,parent:int,label:string,leaf:int>"
#: One row per sentence: character bounds in the document, tokens (0 is ROOT; offsets are within the document, null if
#: the token doesn't stand in the text), dependency edges and constituency nodes.
SENTENCE = f"doc_id string, sent_id int, start int, end int, text string, tokens array<{TOKEN}>, edges array<{EDGE}>, nodes array<{NODE}>"
INSTANCE = "doc_id string, sent_id int, inst_id string, kind string, connective array<int>, cause array<int>, effect array<int>, means array<int>, causal_type string, degree string, overlap_types array<string>, attached_inst_id string"


def general_tag(tag: str | None) -> str | None:
    """Coarse part of speech: the families of nouns, verbs, adjectives and adverbs by their first tag; others as they are."""
    if tag is None:
        return None
    for family in ("NN", "VB", "JJ", "RB"):
        if tag.startswith(family):
            return family
    return tag
