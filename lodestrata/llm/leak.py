"""Evaluation texts leaking into training text, by a generalised suffix automaton over normalised words.

The automaton of all test items is built once and shipped to the tasks; documents stream through it word by word.  The
state after a word is the longest run of words ending there that occurs in any item; the items of the state's shortest
ancestor still long enough are those that leak there.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
#: Bytes of test items in one automaton.
PART_BYTES = 2 << 20
#: Characters that show nothing: soft hyphen, joiners, zero-width blanks, direction marks, variation selectors, BOM.
INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿]")


def words(text: str) -> list[str]:
    """Words that count: runs of letters and digits, of the compatibility form, in one case, invisible signs out."""
    if not text.isascii():
        text = INVISIBLE.sub("", text)
        if not unicodedata.is_normalized("NFKC", text):
            text = INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
        return WORD.findall(unicodedata.normalize("NFKC", text.casefold()))
    return WORD.findall(text.lower())


def words_at(text: str) -> list[tuple[str, int, int]]:
    """(word, start, end) with the places in the text as it is; slower than :func:`words`, for texts with a match."""
    flat, at = [], []
    k, n = 0, len(text)
    while k < n:
        j = k + 1
        while j < n and (unicodedata.combining(text[j]) or INVISIBLE.match(text[j])):
            j += 1
        for c in unicodedata.normalize("NFKC", INVISIBLE.sub("", unicodedata.normalize("NFKC", INVISIBLE.sub("", text[k:j]))).casefold()):
            flat.append(c)
            at.append((k, j))
        k = j
    return [(m[0], at[m.start()][0], at[m.end() - 1][1]) for m in WORD.finditer("".join(flat))]


class Automaton:
    """Generalised suffix automaton of word sequences; ``items`` of a state are those its words occur in.

    Most states have one way on.  Those are kept in arrays of numbers, only the others in dictionaries, and states with
    the same items share one tuple, so that a task holds some tens of bytes a word of the items.
    """

    def __init__(self, texts: list[tuple[int, list[str]]], least: int) -> None:
        numbers: dict[str, int] = {}
        ways: list[dict[int, int]] = [{}]
        link, length = array("i", [-1]), array("i", [0])
        own: list[frozenset[int]] = [frozenset()]
        for item, seq in texts:
            last, me = 0, frozenset((item,))
            for word in seq:
                last = _extend(ways, link, length, own, last, numbers.setdefault(word, len(numbers)))
                own[last] |= me
        sets: dict[frozenset[int], int] = {frozenset(): 0}
        for v in sorted(range(1, len(link)), key=length.__getitem__, reverse=True):
            if not own[v] <= own[link[v]]:
                own[link[v]] |= own[v]
        self.of = array("i", [sets.setdefault(own[v], len(sets)) if length[v] >= least else 0 for v in range(len(link))])
        self.sets = [tuple(sorted(x)) for x in sets]
        self.numbers, self.link, self.length, self.least = numbers, link, length, least
        self.word, self.to = array("i", [-1]) * len(link), array("i", [0]) * len(link)
        self.more: dict[int, dict[int, int]] = {}
        for v, d in enumerate(ways):
            if len(d) == 1:
                ((self.word[v], self.to[v]),) = d.items()
            elif d:
                self.more[v] = d
        self.root = {w: ways[0][n] for w, n in numbers.items() if n in ways[0]}

    def items(self, v: int) -> tuple[int, ...]:
        return self.sets[self.of[v]]

    def ends(self, seq: list[str]) -> list[tuple[int, int, int]]:
        """(index, state, length) of every word at which a match of at least ``least`` words ends."""
        number, word, to, more, link, length, least, root = self.numbers.get, self.word, self.to, self.more, self.link, self.length, self.least, self.root
        v, n, out = 0, 0, []
        for k, w in enumerate(seq):
            if not v:
                v = root.get(w, 0)
                n = 1 if v else 0
            else:
                x = number(w, -2)
                if x < 0:
                    v = n = 0
                    continue
                while True:
                    if word[v] == x:
                        v = to[v]
                        n += 1
                        break
                    d = more.get(v)
                    if d is not None and x in d:
                        v = d[x]
                        n += 1
                        break
                    if not v:
                        break
                    v = link[v]
                    n = length[v]
            if n >= least:
                out.append((k, v, n))
        return out

    def matches(self, seq: list[str]) -> dict[int, list[tuple[int, int]]]:
        """Item -> spans [start, end) of words, each the longest of that item ending there."""
        found: dict[int, list[tuple[int, int]]] = {}
        for k, v, n in self.ends(seq):
            seen: set[int] = set()
            while v > 0 and n >= self.least:
                for item in self.items(v):
                    if item not in seen:
                        seen.add(item)
                        found.setdefault(item, []).append((k + 1 - n, k + 1))
                v = self.link[v]
                n = self.length[v]
        return found


def _clone(ways: list, link: array, length: array, own: list, p: int, q: int, w: int) -> int:
    c = len(link)
    ways.append(dict(ways[q]))
    link.append(link[q])
    length.append(length[p] + 1)
    own.append(frozenset())
    link[q] = c
    while p != -1 and ways[p].get(w) == q:
        ways[p][w] = c
        p = link[p]
    return c


def _extend(ways: list, link: array, length: array, own: list, last: int, w: int) -> int:
    q = ways[last].get(w)
    if q is not None:
        return q if length[q] == length[last] + 1 else _clone(ways, link, length, own, last, q, w)
    cur = len(link)
    ways.append({})
    link.append(0)
    length.append(length[last] + 1)
    own.append(frozenset())
    p = last
    while p != -1 and w not in ways[p]:
        ways[p][w] = cur
        p = link[p]
    if p != -1:
        q = ways[p][w]
        link[cur] = q if length[q] == length[p] + 1 else _clone(ways, link, length, own, p, q, w)
    return cur


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def automata(items: DataFrame, least: int, part_bytes: int = PART_BYTES) -> Iterator[tuple[Automaton, dict[int, int]]]:
    """Automata of the test items and their sizes in words, one for every ``part_bytes`` or so of text.

    The items of a part are brought to the driver together, one part after another; a part is as large as ``part_bytes``
    or as its largest item.
    """
    held = items.select("item_id", "text").where(F.col("text").isNotNull() & F.col("item_id").isNotNull())
    size = held.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // part_bytes)
    for k in range(parts):
        rows = held.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k).distinct().collect()
        texts = [(r[0], w) for r in sorted(map(tuple, rows)) if len(w := words(r[1])) >= least]
        sizes: dict[int, int] = {}
        for i, w in texts:
            sizes[i] = max(len(w), sizes.get(i, 0))
        yield Automaton(texts, least), sizes


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", "text").where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())


def _over_parts(documents: DataFrame, items: DataFrame, least: int, part_bytes: int, scan: Callable, schema: str) -> DataFrame:
    """The rows of ``scan`` over the documents for the automaton of every part of the items."""
    out = None
    for auto, sizes in automata(items, least, part_bytes):
        held = documents.sparkSession.sparkContext.broadcast((auto, sizes))
        rows = documents.mapInArrow(partial(scan, held), schema)
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else documents.sparkSession.createDataFrame([], schema)


def _leaks_of(held, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    auto, sizes = held.value
    for batch in batches:
        out = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for item, spans in auto.matches(words(text.as_py())).items():
                m = _merged(spans)
                longest = max(z - a for a, z in spans)
                out.append((doc, item, longest, sum(z - a for a, z in m), sizes[item], longest / sizes[item], len(m)))
        cols = list(zip(*out, strict=True)) if out else [[]] * 7
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "item_id", "longest", "covered", "item_words", "coverage", "n_spans"])


def leaks(documents: DataFrame, items: DataFrame, least: int = 12, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per document and item of which it holds at least ``least`` consecutive words.

    Columns: doc_id, item_id, longest (words), covered (words of the item's matches in the document), item_words,
    coverage (longest over item_words), n_spans.  Null or blank texts and items give no rows, an item shorter than
    ``least`` words can't leak, and a repeated document counts once.  Items of more than ``part_bytes`` are taken in parts,
    each of which reads the documents once.
    """
    schema = "doc_id bigint, item_id bigint, longest int, covered int, item_words int, coverage double, n_spans int"
    return _over_parts(_texts(documents), items, least, part_bytes, _leaks_of, schema).distinct()


def _spans_of(held, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    auto, _ = held.value
    for batch in batches:
        out = []
        for doc, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            t = text.as_py()
            if auto.ends(words(t)):
                ends = auto.ends([w for w, _, _ in words_at(t)])
                out.append((doc, h, [{"a": a, "z": z} for a, z in _merged([(k + 1 - n, k + 1) for k, _, n in ends])]))
        cols = list(zip(*out, strict=True)) if out else [[]] * 3
        types = [pa.int64(), pa.int64(), pa.list_(pa.struct([("a", pa.int32()), ("z", pa.int32())]))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "h", "spans"])


def cleaned(documents: DataFrame, items: DataFrame, least: int = 12, coverage: float = 0.8, part_bytes: int = PART_BYTES) -> DataFrame:
    """Documents with a leak, without it: spans of at least ``least`` words are cut out of the text as it is.

    Columns: doc_id, n_spans, removed_chars, dropped, text.  A document of which leaks cover the share ``coverage`` or
    more of its words is dropped (text empty, dropped true).  Documents without a leak give no row.
    """
    docs = _texts(documents).withColumn("h", F.xxhash64("text"))
    schema = "doc_id bigint, h bigint, spans array<struct<a: int, z: int>>"
    spans = _over_parts(docs.select("doc_id", "h", "text"), items, least, part_bytes, _spans_of, schema)
    spans = spans.groupBy("doc_id", "h").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, found, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = value.as_py()
                placed = words_at(text)
                m = _merged([(x["a"], x["z"]) for x in found])
                if sum(z - a for a, z in m) >= coverage * len(placed):
                    out.append((doc, len(m), len(text), True, ""))
                    continue
                rest, at = [], 0
                for a, z in m:
                    rest.append(text[at : placed[a][1]])
                    at = placed[z - 1][2]
                kept = "".join([*rest, text[at:]])
                out.append((doc, len(m), len(text) - len(kept), False, kept))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "n_spans", "removed_chars", "dropped", "text"])

    rows = docs.join(spans, ["doc_id", "h"]).select("doc_id", "spans", "text")
    return rows.mapInArrow(cut, "doc_id bigint, n_spans int, removed_chars bigint, dropped boolean, text string").dropDuplicates(["doc_id", "text"])
