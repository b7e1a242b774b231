"""Text columns: sanitizing, slugs, snippets, fingerprints, SimHash, dialect compression, markdown sections."""

from __future__ import annotations

import hashlib
import json
import re
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BLANKS = r"[ \t\n\r\f]"
# What a query and a slug may not hold, the two kinds of links, what begins a section, and the words that tell what a query is after.
NOT_IN_QUERIES, SLUG = r"[^A-Za-z0-9_'\- ]+", r"[A-Za-z0-9_./-]+"
WIKI_LINK, INLINE_LINK = r"\[\[([A-Za-z0-9_/.\-]+)\]\]", r"\[[^\]]*\]\(\.?/?([A-Za-z0-9_/\-]+?)(?:\.md)?\)"
HEADING = r"[ \t]*#{1,6}[ \t]"
INTENTS = {"tag": ("tag:",), "backlink": ("backlink", "links to"), "temporal": ("today", "yesterday", "timeline"), "relational": ("related", "depends on", "connects")}


def sanitize(query: Column) -> Column:
    """Every run of characters outside A-Z a-z 0-9 _ ' - becomes one blank, without blanks at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(query, NOT_IN_QUERIES, " "), " +", " "))


def valid_slug(slug: Column) -> Column:
    """Whether a slug is a non-empty run of ASCII letters, digits and - _ / . without / at its ends; null for null."""
    return slug.rlike(rf"\A{SLUG}\z") & ~slug.startswith("/") & ~slug.endswith("/")


def is_slug(slug: str) -> bool:
    """`valid_slug` of one string on the driver."""
    return re.fullmatch(SLUG, slug) is not None and not slug.startswith("/") and not slug.endswith("/")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{_BLANKS}+|{_BLANKS}+\z", "")


#: Characters of a snippet.
SNIPPET = 200


def snippet(text: Column, size: int = SNIPPET) -> Column:
    """The first characters of a text, trimmed."""
    return trimmed(F.substring(text, 1, size))


def intent(query: Column) -> Column:
    """What a query is after, by fixed words in it; the first kind that applies."""
    q = F.translate(query, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.when(query.isNull(), None)
    for kind, words in INTENTS.items():
        has = reduce(or_, (q.contains(w) for w in words))
        found = found.when(has | q.startswith("#") if kind == "tag" else has, kind)
    return found.otherwise("semantic")


def links_in(body: Column, source_slug: Column) -> Column:
    """The slugs a markdown text refers to, sorted, each once: [[slug]], and [text](./slug.md) with or without ./ and .md; not the page itself, no web addresses."""
    wiki = F.regexp_extract_all(body, F.lit(WIKI_LINK), 1)
    inline = F.regexp_extract_all(body, F.lit(INLINE_LINK), 1)
    inline = F.filter(inline, lambda x: ~x.startswith("http"))
    return F.array_sort(F.array_distinct(F.filter(F.concat(wiki, inline), lambda x: x != source_slug)))


def sections(markdown: Column) -> Column:
    """The sections of a markdown text: each heading of one to six # followed by a blank begins one; trimmed, without blank ones."""
    parts = F.split(markdown, rf"(?<![^\n])(?={HEADING})")
    return F.filter(F.transform(parts, trimmed), lambda x: x != "")


@F.pandas_udf(T.BinaryType())
def fingerprint(text: pd.Series) -> pd.Series:
    """BLAKE2b in 16 bytes of the JSON form of a string, quotes and escapes included; null for null."""
    return text.map(lambda x: None if x is None else hashlib.blake2b(json.dumps(x, ensure_ascii=False).encode(), digest_size=16).digest())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def fake_embedding(text: pd.Series) -> pd.Series:
    """A deterministic stand-in for an embedding, of 16 numbers: byte i of the fingerprint / 255 - 0.5 + i / 1000."""

    def one(x: str | None) -> np.ndarray | None:
        if x is None:
            return None
        digest = hashlib.blake2b(json.dumps(x, ensure_ascii=False).encode(), digest_size=16).digest()
        return (np.frombuffer(digest, np.uint8) / 255 - 0.5 + np.arange(16) / 1000).astype(np.float32)

    return text.map(one)


def uuid_of(digest: Column) -> Column:
    """16 bytes as a UUID's text."""
    return F.regexp_replace(F.lower(F.hex(digest)), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


@F.pandas_udf(T.LongType())
def simhash64(text: pd.Series) -> pd.Series:
    """SimHash over the tokens between white space: each of the first 64 bits of a token's SHA-256 (little-endian) votes by its sign; a bit is set for a sum of 0 or more."""
    tokens = [x.split() if x is not None else [] for x in text]
    sizes = np.array([len(t) for t in tokens])
    seen: dict[str, int] = {}
    rows = np.fromiter((seen.setdefault(w, len(seen)) for t in tokens for w in t), np.int64, int(sizes.sum()))
    votes = np.zeros((len(tokens), 64), np.int64)
    if len(rows):
        digests = np.frombuffer(b"".join(hashlib.sha256(w.encode()).digest()[:8] for w in seen), np.uint8).reshape(-1, 8)
        signs = np.unpackbits(digests, axis=1, bitorder="little").astype(np.int8) * 2 - 1
        full = sizes > 0
        begins = (np.cumsum(sizes) - sizes)[full]
        votes[full] = np.add.reduceat(signs[rows].astype(np.int32), begins, axis=0)
    packed = np.packbits(votes >= 0, axis=1, bitorder="little").view("<i8").ravel()
    return pd.Series(packed, index=text.index).astype("Int64").mask(text.isna())


# Words that signal an emotion or a flag, and the words that are dropped.
EMOTIONS = {
    "decided": "determ", "prefer": "convict", "worried": "anx", "excited": "excite", "frustrated": "frust", "confused": "confuse", "love": "love",
    "hate": "rage", "hope": "hope", "fear": "fear", "trust": "trust", "happy": "joy", "sad": "grief",
}
FLAGS = {
    "decided": "DECISION", "chose": "DECISION", "switched": "DECISION", "migrated": "DECISION", "created": "ORIGIN", "started": "ORIGIN",
    "core": "CORE", "fundamental": "CORE", "breakthrough": "PIVOT", "api": "TECHNICAL", "database": "TECHNICAL", "architecture": "TECHNICAL",
}
STOPWORDS = (
    "the a an is are was were be to of in for on with at by from as and but or if this that it its i we you they my our their have has had "
    "will would could should because like about into"
).split()


def compress_dialect(text: Column, entities: dict[str, str] | None = None) -> Column:
    """A short form of a text: its tokens of three or more letters, _ and -, lower-cased, without stop words, each followed by what it signals.

    A token that is an entity (given in lower case) is replaced by the entity's code alone.
    """
    pairs = lambda d: F.create_map(*(F.lit(x) for kv in d.items() for x in kv))
    tokens = F.transform(F.regexp_extract_all(text, F.lit(r"([A-Za-z][A-Za-z_-]{2,})"), 1), F.lower)
    entity = pairs(entities) if entities else F.create_map().cast("map<string,string>")
    emotions, flags = pairs({k: f"emotion_{v}" for k, v in EMOTIONS.items()}), pairs(FLAGS)
    kept = F.filter(tokens, lambda x: ~x.isin(*STOPWORDS) | F.coalesce(F.map_contains_key(entity, x), F.lit(False)))
    spread = F.transform(kept, lambda x: F.when(F.map_contains_key(entity, x), F.array(F.element_at(entity, x))).otherwise(F.array_compact(F.array(x, F.try_element_at(emotions, x), F.try_element_at(flags, x)))))
    return F.array_join(F.flatten(spread), " ")


def compression_ratio(text: Column, entities: dict[str, str] | None = None) -> Column:
    """Bytes of the short form per byte of the text; 1 for an empty text."""
    return F.when(F.octet_length(text) == 0, F.lit(1.0)).otherwise(F.octet_length(compress_dialect(text, entities)) / F.octet_length(text))
