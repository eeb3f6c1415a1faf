"""Benchmark decontamination with a generalised suffix automaton.

Test items and documents are cut into lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. The automaton
of all items (words as symbols) reads each document's words and tracks the longest match that ends at each word.
A window - ``window`` consecutive words of an item, or a whole item that has fewer - occurs where the tracked match
is at least as long and, cut to the window's length, is that window. Words inside any occurrence are hit.

Most words can't belong to a match of the shortest window's length: before the automaton reads, runs of words
whose neighbouring pairs all occur in items are found on whole Arrow batches, and only runs of at least that length
are read; elsewhere the tracked match is too short by construction.

Items are read in groups of about ``max_item_bytes`` of text (a longer item is a group of its own). The driver builds one group's
automaton at a time and keeps it as flat arrays. As many groups as fit in ``max_pass_bytes`` of arrays, which are
measured, make one pass over the documents; a larger benchmark takes several passes, each of which adds its hits to a written
table, so neither driver nor workers ever hold more than one pass's arrays.

Null or empty texts have no words and no hits; null or wordless items have no windows. An id that repeats with
another text owns the windows of all its texts, items without an id count as one item whose id is null, and
repeated items count once. Rows of documents map one to one, and their other columns are left alone.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm.store import Scratch, bounded, free_names, slices
from papyra.llm.words import ALNUM_WORDS, Words, buffers

WINDOW = 10
MAX_ITEM_BYTES, MAX_PASS_BYTES = 1 << 20, 128 << 20
#: A document goes whole if more than this share of its words is hit.
MAX_COVERAGE = 0.5
FOUND = "n_words long, spans array<struct<start:long,stop:long>>, item_ids array<long>"


class Automaton:
    """Suffix automaton of several word sequences, each with its item, and the windows that end in each state.

    It is built from dictionaries and kept as flat arrays: transitions as sorted keys ``state * words + word``.
    """

    def __init__(self, items: list[tuple[int | None, list[int]]], window: int, words: int):
        self.window, self.words = window, max(1, words)
        self.next, self.link, self.length = [{}], [-1], [0]
        owners: list[set[int | None]] = [set()]
        for item, seq in items:
            last = 0
            for w in seq:
                last = self._extend(last, w, owners)
                owners[last].add(item)
        for s in sorted(range(1, len(self.length)), key=lambda s: -self.length[s]):
            owners[self.link[s]] |= owners[s] if self.link[s] else set()
        order = sorted(range(len(self.length)), key=self.length.__getitem__)
        #: for each state the ancestor, or itself, that holds its suffix of window words; -1: none
        self.full = [-1] * len(order)
        for s in order[1:]:
            up = self.link[s]
            self.full[s] = self.full[up] if self.full[up] >= 0 else s if self.length[s] >= window else -1
        #: items whose windows end in a state: runs of owned, by position in the sorted holders
        holders = sorted(set(self.full) - {-1})
        self.holders, self.owned, self.ends = array("q", holders), [], array("q", [0])
        for s in holders:
            self.owned += owners[s]
            self.ends.append(len(self.owned))
        self.owned = np.array([(-1 if x is None else x) for x in self.owned], np.int64), np.array([x is None for x in self.owned], bool)
        #: whole items of fewer words: state -> words -> items
        self.short: dict[int, dict[int, set[int | None]]] = {}
        for item, seq in items:
            if len(seq) < window:
                s = 0
                for w in seq:
                    s = self.next[s][w]
                self.short.setdefault(s, {}).setdefault(len(seq), set()).add(item)
        moves = sorted((s * self.words + w, to) for s, out in enumerate(self.next) for w, to in out.items())
        self.keys, self.to = array("q", [k for k, _ in moves]), array("i", [t for _, t in moves])
        self.link, self.length, self.full = array("i", self.link), array("i", self.length), array("i", self.full)
        del self.next

    def size(self) -> int:
        """Bytes of the arrays."""
        held = (self.keys, self.to, self.link, self.length, self.full, self.holders, self.ends)
        return sum(x.itemsize * len(x) for x in held) + 9 * len(self.owned[0]) + 200 * len(self.short)

    def items_of(self, state: int) -> list[int | None]:
        at = bisect_left(self.holders, state)
        ids, none = (x[self.ends[at] : self.ends[at + 1]].tolist() for x in self.owned)
        return [None if n else i for i, n in zip(ids, none, strict=True)]

    def _extend(self, last: int, w: int, owners: list) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, q, w, owners)
        cur = len(length)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        owners.append(set())
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, w, owners)
        return cur

    def _clone(self, p: int, q: int, w: int, owners: list) -> int:
        c = len(self.length)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        owners.append(set())
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def read(self, words: Iterable[int]) -> tuple[list[tuple[int, int]], set[int | None]]:
        """Spans of word positions (from, to) that are hit, and the items whose windows occur."""
        keys, to, link, length, full, short, window = self.keys, self.to, self.link, self.length, self.full, self.short, self.window
        spans: list[tuple[int, int]] = []
        found: set[int | None] = set()
        ended: set[int] = set()
        s = n = 0
        last = len(keys)
        for i, w in enumerate(words):
            while True:
                key = s * self.words + w
                at = bisect_left(keys, key)
                if at < last and keys[at] == key:
                    s = to[at]
                    n += 1
                    break
                if not s:
                    n = 0
                    break
                s = link[s]
                n = length[s]
            if not n:
                continue
            size = 0
            if n >= window and full[s] >= 0:
                size = window
                ended.add(full[s])
            if short:
                t = s
                while t > 0:
                    for k, items in short.get(t, {}).items():
                        if k <= n:
                            size = max(size, k)
                            found |= items
                    t = link[t]
            if size:
                a = i + 1 - size
                while spans and spans[-1][1] >= a:
                    a = min(a, spans.pop()[0])
                spans.append((a, i + 1))
        for s in ended:
            found.update(self.items_of(s))
        return spans, found


class Matcher:
    """The automaton of some items together with what finds the runs of words that it must read."""

    def __init__(self, items: list[tuple[int | None, str]], window: int):
        w = Words(pa.array([t for _, t in items], pa.string()), ALNUM_WORDS)
        self.vocabulary, codes = np.unique(w.hashes, return_inverse=True)
        seqs = [(i, codes[w.first[k] : w.first[k + 1]].tolist()) for k, (i, _) in enumerate(items) if w.first[k + 1] > w.first[k]]
        self.automaton = Automaton(seqs, window, len(self.vocabulary))
        self.least = min((min(window, len(x)) for _, x in seqs), default=0)
        inside = np.ones(max(0, len(codes) - 1), bool)
        cut = w.first[1:-1]
        inside[cut[(cut > 0) & (cut < len(codes))] - 1] = False
        n = np.int64(max(1, len(self.vocabulary)))
        self.pairs = np.unique((codes[:-1] * n + codes[1:])[inside])
        self.bits = max(16, int(len(self.vocabulary)).bit_length() + 6)
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[(self.vocabulary >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def size(self) -> int:
        return self.automaton.size() + self.vocabulary.nbytes + self.pairs.nbytes + self.seen.nbytes

    def runs(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of all words (-1: in no item), and first word and length of each run to read."""
        code = np.full(len(w.hashes), -1, np.int64)
        maybe = np.flatnonzero(self.seen[(w.hashes >> np.uint64(64 - self.bits)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, w.hashes[maybe]), len(self.vocabulary) - 1)
        hit = self.vocabulary[at] == w.hashes[maybe]
        code[maybe[hit]] = at[hit]
        both = np.flatnonzero((code[:-1] >= 0) & (code[1:] >= 0))
        last = w.first[1:-1] - 1  # pairs don't cross texts
        both = both[~np.isin(both, last)]
        if len(self.pairs):
            pair = code[both] * np.int64(len(self.vocabulary)) + code[both + 1]
            both = both[self.pairs[np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)] == pair]
        else:
            both = both[:0]
        joined = np.zeros(len(code), bool)  # this word and the next
        joined[both] = True
        starts = (code >= 0) & ~np.concatenate([[False], joined[:-1]])
        first = np.flatnonzero(starts)
        ends = np.flatnonzero((code >= 0) & ~joined)
        size = ends - first + 1
        keep = size >= self.least
        return code, first[keep], size[keep]

    def scan(self, w: Words) -> dict[int, tuple[list[tuple[int, int]], set[int | None]]]:
        """For each text with hits: spans of its word positions and items."""
        out: dict[int, tuple[list, set]] = {}
        if not self.least or not len(w.hashes):
            return out
        code, first, size = self.runs(w)
        doc = np.searchsorted(w.first, first, side="right") - 1
        for d, a, k in zip(doc.tolist(), first.tolist(), size.tolist(), strict=True):
            spans, items = self.automaton.read(code[a : a + k].tolist())
            if spans:
                base = a - int(w.first[d])
                all_spans, all_items = out.setdefault(d, ([], set()))
                all_spans += [(base + x, base + y) for x, y in spans]
                all_items |= items
        return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _last(item: int | None) -> tuple[bool, int]:
    """Key that sorts a null id behind the others."""
    return item is None, item or 0


def matchers(benchmark: DataFrame, window: int, max_item_bytes: int, id_col: str, text_col: str) -> Iterator[Matcher]:
    """One for each group of items; the driver holds one group's texts at a time."""
    items = benchmark.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{text_col}`").cast("string").alias("t")).where("t is not null").distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    groups = -(-total // max_item_bytes) if total else 0
    for g in range(groups):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(groups)) == g).collect()
        if part:
            yield Matcher(sorted(((r.i, r.t) for r in part), key=lambda x: (_last(x[0]), x[1])), window)


def passes(found: Iterator[Matcher], max_pass_bytes: int) -> Iterator[list[Matcher]]:
    """Lists of matchers whose arrays fit in max_pass_bytes together; at least one list, which may be empty."""
    held: list[Matcher] = []
    total = 0
    for m in found:
        if held and total + m.size() > max_pass_bytes:
            yield held
            held, total = [], 0
        held.append(m)
        total += m.size()
    yield held


def _scanner(docs: DataFrame, found: list[Matcher], clean: bool):
    """A UDF of a text and its earlier hits, if there are any; if clean, it also gives ``rest``, the text without all hits.

    It is one UDF, as a second one that reads its result would be given a Python worker of its own for each task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(found)

    def part(text: pa.Array, before) -> pa.StructArray:
        w = Words(text, ALNUM_WORDS)
        hits: dict[int, tuple[list, set]] = {}
        if before is not None:
            for d, x in enumerate(before.to_pylist()):
                if x["spans"]:
                    hits[d] = [(y["start"], y["stop"]) for y in x["spans"]], set(x["item_ids"])
        for m in shared.value:
            for d, (spans, items) in m.scan(w).items():
                a, b = hits.setdefault(d, ([], set()))
                a += spans
                b |= items
        spans = [[{"start": x, "stop": y} for x, y in merged(hits[d][0])] if d in hits else [] for d in range(len(w))]
        items = [sorted(hits[d][1], key=_last) if d in hits else [] for d in range(len(w))]
        cols = [pa.array(np.diff(w.first), pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(items, pa.list_(pa.int64()))]
        del w
        if clean:
            cols.append(_without(text, spans))
        return pa.StructArray.from_arrays(cols, names=["n_words", "spans", "item_ids", "rest"][: len(cols)])

    def run(text: pa.Array, before) -> pa.Array:
        done = [part(text.slice(lo, hi - lo), None if before is None else before.slice(lo, hi - lo)) for lo, hi in slices(buffers(text)[1], 8 << 20)]
        return pa.concat_arrays(done) if done else part(text, before)

    def first(text: pa.Array) -> pa.Array:
        return run(text, None)

    def later(text: pa.Array, before: pa.Array) -> pa.Array:
        return run(text, before)

    # said to be nondeterministic, so that a filter on the hits doesn't read the texts once more
    kind = f"{FOUND}, rest string" if clean else FOUND
    return F.arrow_udf(first, kind).asNondeterministic(), F.arrow_udf(later, kind).asNondeterministic()


def _without(text: pa.Array, spans: list[list[dict[str, int]]]) -> pa.Array:
    """Texts without the words of their spans; null where there are none. Only texts with spans are cut into words again."""
    at = [d for d, x in enumerate(spans) if x]
    out: list[str | None] = [None] * len(spans)
    w = Words(text.take(pa.array(at, pa.int64())), ALNUM_WORDS, spans=True)
    for k, d in enumerate(at):
        lo, hi, f = int(w.offsets[k]), int(w.offsets[k + 1]), int(w.first[k])
        kept = []
        for x in spans[d]:
            kept.append(bytes(w.raw[lo : w.starts[f + x["start"]]]))
            lo = int(w.ends[f + x["stop"] - 1])
        kept.append(bytes(w.raw[lo:hi]))
        out[d] = b"".join(kept).decode()
    return pa.array(out, pa.string())


def _hits(docs: DataFrame, name: str, found: Iterator[Matcher], text_col: str, max_pass_bytes: int, clean: bool = False) -> DataFrame:
    """docs with a column ``name``: words, hit spans (in words) and items; if clean, ``rest`` as well: the text without the hits, null without any."""
    docs = bounded(docs, 4096)
    tables, out, before = Scratch(docs.sparkSession), docs, None
    text = F.col(f"`{text_col}`").cast("string")
    lists = passes(found, max_pass_bytes)
    here = next(lists)
    while here is not None:
        after = next(lists, None)
        first, later = _scanner(docs, here, clean and after is None)
        out = out.withColumn(name, first(text) if before is None else later(text, F.col(name)))
        here = after
        if here is not None:  # the next pass must not hold this one's arrays
            written = tables.cut(out, "leaks")
            if before is not None:
                tables.drop(before)
            out = before = written
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_item_bytes: int = MAX_ITEM_BYTES, max_pass_bytes: int = MAX_PASS_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, spans (word positions that are hit), item_ids (items with occurring windows)."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    found = matchers(benchmark, window, max_item_bytes, item_col, item_text_col)
    return _hits(rows, "leaks", found, "text", max_pass_bytes).select("doc_id", "leaks.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE, max_item_bytes: int = MAX_ITEM_BYTES, max_pass_bytes: int = MAX_PASS_BYTES, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs without the hit spans; a document goes whole if more than max_coverage of its words is hit.

    Other columns stay, whatever their names, except that ``n_chars``, where there is one, counts the new text.
    """
    (name,) = free_names(docs, "leaks")
    out = _hits(docs, name, matchers(benchmark, window, max_item_bytes, item_col, item_text_col), text_col, max_pass_bytes, clean=True)
    text = F.col(f"`{text_col}`")
    hit = F.aggregate(f"{name}.spans", F.lit(0).cast("long"), lambda n, s: n + s.stop - s.start)
    out = out.where(hit <= F.lit(max_coverage) * F.col(f"{name}.n_words"))
    out = out.withColumn(text_col, F.coalesce(F.col(f"{name}.rest"), text)).drop(name)
    return out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.stop - s.start)
    ids = F.array_join(F.array_sort(F.col("item_ids").cast("array<string>")), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def oracle() -> str:
    """DuckDB SQL for op8: every window joined with every run of as many words."""
    return r"""
with item_words as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
doc_words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
windows as (select distinct item_id, least(len(w), 10) as n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as t
  from (select item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) as i from item_words where len(w) > 0)),
runs as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as t
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from doc_words, (select distinct n from windows))),
found as (select doc_id, item_id, i, n from runs join windows using (n, t)),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from found) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids from (select distinct doc_id, item_id from found) group by doc_id)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from doc_words left join hit using (doc_id) left join items using (doc_id)"""


def brute_force(texts: list[str | None], items: dict[int, str | None], window: int = WINDOW) -> list[tuple[int, int, str]]:
    """(words, hit words, items) by comparing every window with every position; for tests."""
    import re

    def cut(t: str | None) -> list[str]:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", low)

    windows: dict[tuple, set[int]] = {}
    for i, t in items.items():
        w = cut(t)
        for k in range(max(1, len(w) - window + 1)) if w else ():
            windows.setdefault(tuple(w[k : k + window]), set()).add(i)
    sizes = {len(x) for x in windows}
    out = []
    for t in texts:
        w, hit, found = cut(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if x := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= x
        out.append((len(w), len(hit), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()))
    return out
