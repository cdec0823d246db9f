"""Substring deduplication: suffix trees of suffixes partitioned by prefix; deep internal nodes give the maximal repeats."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.codes import ranges
from tidemark.llm.repeats import Rule, without_repeats

WIDTH, ANCHOR, CROWD = 20, 8, 4096


def suffix_tree(labels: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix trees of depth-limited suffixes, one per group, as leaves in order and depth of the node between neighbours.

    labels: a row of symbols per suffix. Returns the leaves in lexical order and lcp, where lcp[i] is the depth of the
    lowest common ancestor of leaves i - 1 and i (-1 across groups): runs of lcp >= d are the internal nodes that are d deep.
    """
    n, depth = labels.shape
    order = np.lexsort((*labels.T[::-1], group))
    a, b = labels[order[1:]], labels[order[:-1]]
    differ = np.concatenate((a != b, np.ones((len(a), 1), bool)), axis=1)
    lcp = np.concatenate(([-1], np.where(group[order[1:]] == group[order[:-1]], differ.argmax(1), -1)))[:n]
    return order, lcp


def deep_nodes(lcp: np.ndarray, depth: int) -> np.ndarray:
    """Number of the node of at least `depth` symbols that each leaf hangs below; leaves alone have a number of their own."""
    return np.cumsum(lcp < depth) - 1


def sort_windows(key: np.ndarray, syms: np.ndarray, lens: np.ndarray, doc: np.ndarray, pos: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of word contexts that also start in an earlier place: (context, first window, past the last window).

    Suffixes of one prefix (the anchor's words) make a tree; a node `width` words deep holds a repeat, of which all but
    the first occurrence count. Runs of such windows are the maximal repeats, returned as one.
    """
    n = lens - width + 1
    starts = np.concatenate(([0], np.cumsum(lens)[:-1]))
    owner = np.repeat(np.arange(len(n)), n)
    at = ranges(starts, n)
    window = at - starts[owner]
    found = np.zeros(len(at), bool)
    cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    total = np.concatenate(([0], np.cumsum(n)))
    i = 0
    while i < len(cut):  # whole prefixes, about 50,000 suffixes at a time
        j = i + 1
        while j < len(cut) and total[cut[j]] - total[cut[i]] < 50_000:
            j += 1
        s = np.arange(total[cut[i]], total[cut[j]] if j < len(cut) else total[-1])
        order, lcp = suffix_tree(syms[at[s][:, None] + np.arange(width)], key[owner[s]])
        s, node = s[order], deep_nodes(lcp, width)
        by = np.lexsort((pos[owner[s]] + window[s], doc[owner[s]], node))
        s, node = s[by], node[by]
        first = np.concatenate(([True], node[1:] != node[:-1]))
        lead = np.flatnonzero(first)[np.cumsum(first) - 1]
        d, p = doc[owner[s]], pos[owner[s]] + window[s]
        found[s] = (d > d[lead]) | (d == d[lead]) & (p > p[lead])
        i = j
    s = np.flatnonzero(found)
    if not len(s):
        return s, s, s
    new = np.concatenate(([True], (s[1:] != s[:-1] + 1) | (owner[s[1:]] != owner[s[:-1]])))
    last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(s) - 1]))
    return owner[s[new]], window[s[new]], window[s[last]] + 1


RULE = Rule(WIDTH, ANCHOR, words=True, within=True, crowd=CROWD, sorter=sort_windows)


def substring_dedup(docs: DataFrame, width: int = WIDTH, carry: bool = False) -> DataFrame:
    """Remove each word covered by a window of `width` words that also starts earlier (smaller doc_id, or same document, earlier).

    Returns doc_id, n_symbols (words), n_removed, spans (maximal repeats, in words), kept (binary: the words that are left,
    joined by one space). Windows are judged on the input. Nulls, ties and empty input: see without_repeats.
    """
    rule = RULE if width == WIDTH else Rule(width, max(1, width * 2 // 5), words=True, within=True, crowd=CROWD, sorter=sort_windows)
    return without_repeats(docs, rule, carry)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    out = substring_dedup(docs)
    return out.select("doc_id", F.col("n_symbols").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: The digest by windows as lists of words.
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT r, doc_id, i, list_slice(w, i, i + {WIDTH - 1}) AS x FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - {WIDTH - 2})) AS i FROM d)),
late AS (SELECT r, i FROM win QUALIFY row_number() OVER (PARTITION BY x ORDER BY doc_id, i) > 1),
gone AS (SELECT r, list(DISTINCT i + j) AS g FROM (SELECT r, i, unnest(range(0, {WIDTH})) AS j FROM late) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(len(g), 0) AS n_removed,
  sha256(array_to_string(CASE WHEN g IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(g, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (r)
"""
