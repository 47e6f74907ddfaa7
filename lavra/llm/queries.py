"""All queries of this subpackage and the SQL that checks them."""

from . import conversations, encode, neighbours, oversized, pack, repetition, scans, sentences

MODULES = [sentences, conversations, scans, oversized, neighbours, encode, pack, repetition]
QUERIES = {k: q for m in MODULES for k, q in m.QUERIES.items()}
ORACLE = {k: q for m in MODULES for k, q in m.ORACLE.items()}
