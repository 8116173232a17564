"""Many keywords in one pass over a text.

All keywords of all groups form a trie, written as one regular expression that finds, at
each place of a text, the longest keyword that begins there; shorter ones that begin
there are its beginnings, and those inside it begin at later places. So one pass finds
every keyword as a substring. The groups that they belong to are the bits of the text's tags.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 63  # groups in one number of the tags; its sign is not used
TAGS = "array<bigint>"


def trie_pattern(words: Iterable[str]) -> str:
    """A regular expression for the longest of ``words`` that a place begins with."""
    root: dict = {}
    for word in words:
        node = root
        for c in word:
            node = node.setdefault(c, {})
        node[""] = {}

    def written(node: dict) -> str:
        ways = [(re.escape(c) if c.isascii() else c) + written(child) for c, child in sorted(node.items()) if c]
        inner = ways[0] if len(ways) == 1 else "|".join(ways)
        if not ways:
            return ""
        if "" in node:
            return f"(?:{inner})?"
        return inner if len(ways) == 1 else f"(?:{inner})"

    return written(root)


class Keywords:
    """Groups of keywords, by name. Keywords are compared as they stand, so give them, and the texts, in lower case."""

    def __init__(self, groups: Mapping[object, Iterable[str]]) -> None:
        self.groups = {name: tuple(words) for name, words in groups.items()}
        self.place = {name: divmod(i, BITS) for i, name in enumerate(self.groups)}
        self.size = max(1, -(-len(self.groups) // BITS))
        own: dict[str, list[int]] = {}
        for name, words in self.groups.items():
            at, bit = self.place[name]
            for word in words:
                if not word:
                    raise ValueError(f"{name!r} has an empty keyword")
                own.setdefault(word, [0] * self.size)[at] |= 1 << bit
        # a keyword also stands for those that it begins with
        self.masks = {w: [sum_of(own[w[:k]][i] for k in range(1, len(w) + 1) if w[:k] in own) for i in range(self.size)] for w in own}

    def mask(self, name: object) -> int:
        """The bit of a group, in the number at ``place[name][0]``."""
        return 1 << self.place[name][1]

    def tags(self, text: Column) -> Column:
        """The groups that have a keyword in ``text``, as bits; none for null."""
        none = F.array(*[F.lit(0).cast("bigint")] * self.size)
        if not self.masks:
            return none
        table = F.from_json(F.lit(json.dumps(self.masks)), f"map<string,{TAGS}>")
        found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?=({trie_pattern(self.masks)}))"), F.lit(1))
        if self.size == 1:  # bits of one number need no arrays on the way
            return F.array(F.aggregate(found, F.lit(0).cast("bigint"), lambda bits, w: bits.bitwiseOR(F.element_at(table, w)[0])))
        return F.aggregate(found, none, lambda bits, w: F.zip_with(bits, F.element_at(table, w), lambda a, b: a.bitwiseOR(b)))

    def has(self, tags: Column, name: object) -> Column:
        """Whether the tags name a group."""
        return tags[self.place[name][0]].bitwiseAND(F.lit(self.mask(name))) != 0

    def needs(self, names: Iterable[object]) -> list[int]:
        """The tags that have all the groups."""
        out = [0] * self.size
        for name in names:
            out[self.place[name][0]] |= self.mask(name)
        return out


def sum_of(masks: Iterable[int]) -> int:
    out = 0
    for m in masks:
        out |= m
    return out


def covers(tags: Column, needed: Column) -> Column:
    """Whether ``tags`` have all bits of ``needed``."""
    return F.forall(F.zip_with(tags, needed, lambda t, n: t.bitwiseAND(n) == n), lambda x: x)


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with more columns that are reckoned once a row, however often later steps use them.

    The optimiser writes an expression out again wherever its column is used, also in filters that it
    moves below; it does not look into generators.
    """
    one = F.struct(*[c.alias(name) for name, c in columns.items()])
    return rows.select(*[F.col(c) for c in rows.columns if c not in columns], F.inline_outer(F.array(one)))
