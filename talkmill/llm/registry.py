"""Queries of this subpackage, by name."""

from talkmill.llm import consensus, conversations, encoding, language, mixing, pii, residue, splits
from talkmill.llm.sql import ORACLES

QUERIES = {
    "p1_found": splits.p1_found,
    "p1_assigned": splits.p1_assigned,
    "p2_found": pii.p2_found,
    "p2_redacted": pii.p2_redacted,
    "p3_found": conversations.p3_found,
    "p3_turns": conversations.p3_turns,
    "p4_found": language.p4_found,
    "p4_segments": language.p4_segments,
    "p5_found": consensus.p5_found,
    "p5_consensus": consensus.p5_consensus,
    "p5_annotators": consensus.p5_annotators,
    "p8_ids": encoding.p8_ids,
    "p8_roundtrip": encoding.p8_roundtrip,
    "p9_documents": mixing.p9_documents,
    "p9_shares": mixing.p9_shares,
    "p10_found": residue.p10_found,
    "p10_clean": residue.p10_clean,
}


def queries() -> dict:
    return dict(QUERIES)


def oracles() -> dict:
    return dict(ORACLES)
