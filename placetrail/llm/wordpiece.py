"""Greedy longest-match token counts with a linear automaton.

The vocabulary forms a byte trie. A node's failure link leads to the node that remains after greedy matching has popped
its longest pieces, and the number of popped pieces is stored beside it; completed over all bytes, the automaton
takes one step a byte and counts pieces without building them.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import WORD_PATTERN, prefix_hash, small_batches, span_hash, text_blocks, unused, word_spans

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Words up to here step together; longer ones are walked one by one.
TOGETHER = 64
ROOT, DEAD = 0, 1


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable Latin-1 as itself, the rest from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """The pieces of a byte-level tokenizer file as byte strings; a leading space marks a word's start."""
    with open(path, encoding="utf-8") as file:
        names = json.load(file)["model"]["vocab"]
    alphabet = byte_alphabet()
    return [bytes(alphabet[c] for c in name) for name in names if all(c in alphabet for c in name)]


@dataclass
class Automaton:
    step: np.ndarray  # (nodes, 256) next node
    popped: np.ndarray  # (nodes, 256) pieces popped on the way, no more than the longest piece has bytes
    final: np.ndarray  # pieces popped at a word's end
    start: int  # node after the word-start mark
    start_popped: int


def build_automaton(pieces: Iterable[bytes], mark: bytes = b" ") -> Automaton:
    """Automaton over words that begin with `mark`. A word that greedy matching cannot cover leads to the dead node
    and counts as one unknown piece."""
    child: list[dict[int, int]] = [{}, {}]
    piece, level = [False, False], [[ROOT]]
    for text in pieces:
        node = ROOT
        for depth, byte in enumerate(text, 1):
            if byte not in child[node]:
                child[node][byte] = len(child)
                child.append({})
                piece.append(False)
                if len(level) == depth:
                    level.append([])
                level[depth].append(len(child) - 1)
            node = child[node][byte]
        if node != ROOT:
            piece[node] = True
    n = len(child)
    step, popped = np.full((n, 256), DEAD, np.int32), np.zeros((n, 256), np.min_scalar_type(len(level)))
    final, link, cost = np.zeros(n, np.int32), np.full(n, DEAD, np.int32), np.zeros(n, np.int32)
    final[DEAD] = -1

    def complete(node: int) -> None:
        """Where the trie has no child, pop along the failure link and step from there."""
        if node != ROOT:
            step[node] = step[link[node]]
            popped[node] = np.where(step[node] == DEAD, 0, cost[node] + popped[link[node]].astype(np.int32))
            final[node] = -1 if final[link[node]] < 0 else final[link[node]] + cost[node]
        for byte, target in child[node].items():
            step[node, byte], popped[node, byte] = target, 0

    parent = {target: (node, byte) for node in range(n) for byte, target in child[node].items()}
    complete(ROOT)
    for nodes in level[1:]:
        for node in nodes:
            if piece[node]:
                link[node], cost[node] = ROOT, 1
            else:
                above, byte = parent[node]
                via = link[above]
                link[node] = DEAD if above == ROOT else step[via, byte]
                cost[node] = 0 if above == ROOT else cost[above] + int(popped[via, byte])
            complete(node)
    start, start_popped = ROOT, 0
    for byte in mark:
        start_popped += int(popped[start, byte])
        start = int(step[start, byte])
    return Automaton(step, popped, final, start, start_popped)


def count_pieces(auto: Automaton, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Greedy pieces of each word data[start:end]."""
    lengths = ends - starts
    node = np.full(len(starts), auto.start, np.int64)
    total = np.full(len(starts), auto.start_popped, np.int64)
    short = np.flatnonzero(lengths <= TOGETHER)
    short = short[np.argsort(-lengths[short], kind="stable")]
    active = np.searchsorted(-lengths[short], -np.arange(TOGETHER), "left")
    for t in range(TOGETHER):
        words = short[: active[t]]
        if not len(words):
            break
        byte = data[starts[words] + t]
        total[words] += auto.popped[node[words], byte]
        node[words] = auto.step[node[words], byte]
    for i in np.flatnonzero(lengths > TOGETHER):
        at, count = int(node[i]), int(total[i])
        for byte in data[starts[i] : ends[i]].tolist():
            count += int(auto.popped[at, byte])
            at = int(auto.step[at, byte])
        node[i], total[i] = at, count
    return np.where(auto.final[node] < 0, 1, total + auto.final[node])


_built: dict[str, Automaton] = {}


def token_counts(docs: DataFrame, pieces: list[bytes], mark: bytes = b" ") -> DataFrame:
    """docs plus n_words and n_tokens (long) of each whole text; null and empty texts have none of either.

    The vocabulary (a fixed table) is sent to the executors; each Python worker builds the automaton once. Words are
    counted once for each distinct word of a block. A long text is a block of its own, and its words are walked byte by byte. Repeated rows are
    counted each, no rows give none. Existing columns of the two names are replaced.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((pieces, mark))
    key = hashlib.sha256(repr((mark, pieces)).encode()).hexdigest()

    @F.arrow_udf("n_words long, n_tokens long")
    def counts(texts: pa.Array) -> pa.Array:
        if key not in _built:
            _built.clear()
            _built[key] = build_automaton(*shared.value)
        words, tokens = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for rows, data, offsets in text_blocks(texts):
            starts, ends, first = word_spans(data, offsets)
            _, once, back = np.unique(span_hash(prefix_hash(data), starts, ends), return_index=True, return_inverse=True)
            each = count_pieces(_built[key], data, starts[once], ends[once])[back]
            words[rows] = np.diff(first)
            total = np.concatenate(([0], np.cumsum(each)))
            tokens[rows] = total[first[1:]] - total[first[:-1]]
        return pa.StructArray.from_arrays([pa.array(words), pa.array(tokens)], ["n_words", "n_tokens"])

    kept = docs.drop("n_words", "n_tokens")
    found = unused("found", kept.columns)
    out = kept.withColumn(found, counts(F.col("text")))
    return out.withColumns({c: F.col(found)[c] for c in ("n_words", "n_tokens")}).drop(found)


#: Greedy longest matches of every distinct word, one piece a round, over the vocabulary read from its file.
ORACLE_SQL = rf"""
WITH RECURSIVE vocabulary AS MATERIALIZED (
  SELECT unnest(json_keys(content, '$.model.vocab')) AS piece FROM read_text('{VOCABULARY}')
), most AS (SELECT max(length(piece)) AS size FROM vocabulary),
bytes AS (SELECT b, b BETWEEN 33 AND 126 OR b BETWEEN 161 AND 172 OR b >= 174 AS plain FROM range(256) t(b)),
alphabet AS MATERIALIZED (
  SELECT list(CASE WHEN plain THEN chr(b::INT) ELSE chr((255 + n)::INT) END ORDER BY b) AS names
  FROM (SELECT *, row_number() OVER (PARTITION BY plain ORDER BY b) AS n FROM bytes)
), w AS MATERIALIZED (
  SELECT doc_id, unnest(regexp_extract_all(text, '{WORD_PATTERN}')) AS word FROM documents
), spelled AS (
  SELECT word, 'Ġ' || array_to_string(list_transform(range(1, octet_length(encode(word)) + 1), lambda i: names[('0x' || substr(hex(encode(word)), 2 * i - 1, 2))::INT + 1]), '') AS rest
  FROM (SELECT DISTINCT word FROM w), alphabet
), r AS (
  SELECT word, rest, 0 AS n FROM spelled
  UNION ALL
  SELECT word, substr(rest, max(k) + 1), n + 1
  FROM (SELECT word, rest, n, unnest(range(1, least(length(rest), most.size) + 1)) AS k FROM r, most WHERE rest <> '') c
  JOIN vocabulary v ON v.piece = substr(c.rest, 1, k) GROUP BY word, rest, n
), each AS (SELECT s.word, coalesce(max(n), 1) AS n FROM spelled s LEFT JOIN r ON r.word = s.word AND r.rest = '' GROUP BY s.word),
total AS (SELECT doc_id, count(*) AS n_words, sum(n) AS n_tokens FROM w JOIN each USING (word) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_tokens, 0)::BIGINT AS n_tokens FROM documents d LEFT JOIN total USING (doc_id)
"""
