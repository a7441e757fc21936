"""Token counts: a longest-match automaton over a vocabulary trie with failure links and popped-token counts."""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from opsloom.llm.texts import SPACED, Hasher, share, shared, slices, words

_KEEP = 1_000_000


def read_pieces(path: str) -> list[bytes]:
    """The pieces of a ranks file: one base64 piece and its rank a line."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


class LongestMatch:
    """Greedy longest-match piece counts in time linear in a word's length, without building the pieces.

    A state that cannot read on pops the pieces that are certain by then (only their number is kept) and goes on,
    by its failure link, in the state of what is left. Bytes that are no piece are added as pieces of their own, so
    an unknown byte counts as one token.
    """

    def __init__(self, pieces: Iterable[bytes]) -> None:
        goto: dict[int, int] = {}
        ends, parent, symbol = [False], [0], [0]
        for piece in {*pieces, *(bytes([b]) for b in range(256))} - {b""}:
            state = 0
            for byte in piece:
                key = state << 8 | byte
                if key not in goto:
                    goto[key] = len(ends)
                    ends.append(False)
                    parent.append(state)
                    symbol.append(byte)
                state = goto[key]
            ends[state] = True
        # Parents are numbered before their children, but a link may lead to a later number: go by depth.
        depth = [0] * len(ends)
        for s in range(1, len(ends)):
            depth[s] = depth[parent[s]] + 1
        fail, pops = [0] * len(ends), [0] * len(ends)
        for s in sorted(range(1, len(ends)), key=depth.__getitem__):
            if ends[s]:
                pops[s] = 1
                continue
            state, popped = fail[parent[s]], pops[parent[s]]
            while state << 8 | symbol[s] not in goto:
                state, popped = fail[state], popped + pops[state]
            fail[s], pops[s] = goto[state << 8 | symbol[s]], popped
        self.goto, self.fail, self.pops = goto, fail, pops

    def count(self, word: bytes) -> int:
        goto, fail, pops = self.goto, self.fail, self.pops
        state = tokens = 0
        for byte in word:
            nxt = goto.get(state << 8 | byte)
            while nxt is None:
                tokens += pops[state]
                state = fail[state]
                nxt = goto.get(state << 8 | byte)
            state = nxt
        while state:
            tokens += pops[state]
            state = fail[state]
        return tokens


def count_tokens(
    docs: DataFrame, pieces: Iterable[bytes], carry: tuple[str, ...] = ("doc_id",), text: str = "text"
) -> DataFrame:
    """Per row: the carried columns, n_bytes, n_words, n_tokens, longest (the most tokens of one word).

    Words are runs without ASCII white space; a word is matched with a space before it, as in vocabularies whose
    pieces carry their leading space. A null or empty text has none of either. Repeated rows are counted each.
    The vocabulary goes to the executors once as a broadcast value; it is bounded by its own file. Counts of words
    seen before are kept per task, at most a million of them, after which the store is begun anew.
    """
    fields = share(docs.sparkSession.sparkContext, LongestMatch(pieces))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match, hasher, known = shared(LongestMatch, fields).count, Hasher(), {}
        for batch in batches:
            columns: list[list] = [[], [], [], []]
            for _, _, data, bounds in slices(batch.column(batch.num_columns - 1)):
                starts, ends, first = words(data, bounds, SPACED)
                hashes, where, which = np.unique(hasher(data, starts, ends), return_index=True, return_inverse=True)
                if len(known) > _KEEP:
                    known.clear()
                raw, each = data.tobytes(), np.zeros(len(hashes), np.int64)
                for i, (h, a, b) in enumerate(zip(hashes.tolist(), starts[where].tolist(), ends[where].tolist(), strict=True)):
                    n = known.get(h)
                    if n is None:
                        n = known[h] = match(b" " + raw[a:b])
                    each[i] = n
                tokens = each[which]
                total = np.concatenate([[0], np.cumsum(tokens)])
                columns[0] += np.diff(bounds).tolist()
                columns[1] += np.diff(first).tolist()
                columns[2] += (total[first[1:]] - total[first[:-1]]).tolist()
                full = first[1:] > first[:-1]
                most = np.zeros(len(full), np.int64)
                if full.any():
                    most[full] = np.maximum.reduceat(tokens, first[:-1][full])
                columns[3] += most.tolist()
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            names = [*carry, "n_bytes", "n_words", "n_tokens", "longest"]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, pa.int64()) for c in columns)], names=names)

    kinds = dict(docs.dtypes)
    own = "n_bytes bigint, n_words bigint, n_tokens bigint, longest bigint"
    return docs.select(*carry, text).mapInArrow(count, ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), own]))
