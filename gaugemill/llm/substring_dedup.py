"""Substring dedup by windows of words: repeated-phrase automata."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .recurring import WINDOW, equal_runs, merged, repeated_windows, word_units
from .textops import run_hashes

PHRASE_WORDS = 10
_OUT = "doc_id long, n_words long, n_removed long, kept string"


def locate(data: np.ndarray, lengths: np.ndarray, anchors: np.ndarray):
    """Windows of one shard: (snippet, offset, group of equal windows).

    ``data`` holds the snippets, words joined by single spaces, ``lengths`` their bytes, ``anchors`` the
    word at which the phrase stands that brought a snippet here. Phrases that at least two snippets
    bear are confirmed by their whole text and compiled into the shard's automaton; all snippets are
    streamed through it, and the windows that hold a located phrase are grouped.
    """
    import ahocorasick

    offsets = np.concatenate(([0], np.cumsum(lengths)))
    h, snippet, start, end = word_units(data, offsets)
    first = np.searchsorted(snippet, np.arange(len(lengths)))
    count = np.bincount(snippet, minlength=len(lengths))
    raw = data.tobytes().decode("latin-1")  # one sign for each byte
    word = first + anchors
    seen: dict[str, int] = {}
    for a, b in zip(start[word].tolist(), end[word + PHRASE_WORDS - 1].tolist(), strict=True):
        phrase = raw[a:b]
        seen[phrase] = seen.get(phrase, 0) + 1
    automaton = ahocorasick.Automaton()
    for phrase, n in seen.items():
        if n > 1:
            automaton.add_word(f" {phrase} ", len(phrase))
    none = np.zeros(0, np.int64)
    if not len(automaton):
        return none, none, none
    automaton.make_automaton()
    cuts = offsets.tolist()
    # No word holds a line feed, so no phrase reaches from one snippet into the next.
    stream = " " + " \n ".join([raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]) + " "
    at = np.fromiter((e - n for e, n in automaton.iter(stream)), np.int64)
    begins = 1 + offsets[:-1] + 3 * np.arange(len(lengths))
    own = np.searchsorted(begins, at, "right") - 1
    q = np.searchsorted(start, offsets[own] + at - begins[own]) - first[own]
    low, high = np.maximum(0, q + PHRASE_WORDS - WINDOW), np.minimum(q, count[own] - WINDOW)
    ok = high >= low
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, first[own[ok]] + low[ok], 1)
    np.add.at(edge, first[own[ok]] + high[ok] + 1, -1)
    windows = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
    return snippet[windows], windows - first[snippet[windows]], equal_windows(word_names(data, start, end), h, windows)


def word_names(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each word; equal words, held against each other by their bytes, have the same."""
    order, new = equal_runs(data, start, end - start)
    out = np.empty(len(start), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def equal_windows(names: np.ndarray, h: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """The group of each window of ``WINDOW`` words. Hashes bring windows together; each is held word by
    word against the first of its hash, and those that differ from it are grouped among themselves."""
    group, left, known = np.zeros(len(windows), np.int64), np.arange(len(windows)), 0
    if not len(windows):
        return group
    text, key = np.lib.stride_tricks.sliding_window_view(names, WINDOW), run_hashes(h, WINDOW)
    while len(left):
        _, first, of = np.unique(key[windows[left]], return_index=True, return_inverse=True)
        lead = windows[left[first]][of]
        same = np.concatenate([(text[windows[left[k : k + 65536]]] == text[lead[k : k + 65536]]).all(1) for k in range(0, len(left), 65536)])
        group[left[same]] = known + of[same]
        known, left = known + len(first), left[~same]
    return group


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` for every row: the words that no repeated window covers, joined
    by one space. A window is 50 consecutive words of one text; it is repeated if its words also start
    in a document with a smaller id. Phrases and windows are confirmed word by word.

    Null, empty and blank texts have no words; texts with fewer than 50 words lose none. See
    ``recurring`` for null and repeated ids. An empty table gives an empty result.
    """
    texts, decisions = repeated_windows(docs, word_units, PHRASE_WORDS, locate, 1 / 90, b" ", id_col, text_col)

    def apply(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            out = []
            for packed, whole, spans in zip(*(batch.column(c) for c in ("packed", "whole", "spans")), strict=True):
                w = unpack.decompress(packed.as_py()).split()
                n = len(w)
                cut = np.array([[0, n]] if n >= WINDOW else []).reshape(-1, 2) if whole.as_py() else merged(spans.as_py() or [])
                for a, b in cut[::-1].tolist():
                    del w[a:b]
                out.append((n, n - len(w), b" ".join(w).decode()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))]], names=["doc_id", "n_words", "n_removed", "kept"])

    return texts.join(decisions, ["doc_id", "mark"], "left").select("doc_id", "packed", "whole", "spans").mapInArrow(apply, _OUT)


def op5_substring_dedup(spark, sf_dir):
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op5_substring_dedup": op5_substring_dedup}
SQL = {
    "op5_substring_dedup": rf"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS u FROM documents),
      e AS (SELECT doc_id, u, unnest(range(1, len(u) + 1)) AS i FROM d),
      w AS (SELECT doc_id, i, u[i] AS x, CASE WHEN i + {WINDOW - 1} <= len(u) THEN md5(array_to_string(u[i : i + {WINDOW - 1}], ' ')) END AS h FROM e),
      f AS (SELECT *, h IS NOT NULL AND min(doc_id) OVER (PARTITION BY h) < doc_id AS again FROM w),
      c AS (SELECT *, coalesce(max(CASE WHEN again THEN i END) OVER (PARTITION BY doc_id ORDER BY i) > i - {WINDOW}, false) AS gone FROM f),
      k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(x, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
      SELECT d.doc_id, len(u) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""
}
