"""The Best Position Algorithm over the impact lists of one block of documents.

A block holds the postings of its documents for all terms asked for. Per term they are
sorted by falling impact, which gives a document a position in the list. A query reads
its lists in rounds; each document met is looked up in all lists at once (direct access),
which marks its positions there as seen. The best position of a list is the last one up
to which all have been seen, so it may lie well ahead of what was read, and the impacts
just behind the best positions bound every document not met yet.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Positions read from each list in a round.
STEP = 16


@dataclass
class Best:
    """The best rows so far: scores, highest first, with the keys that break ties."""

    k: int
    scores: np.ndarray
    keys: np.ndarray
    met: int = 0
    #: Documents that hold a term, met or not.
    held: int = 0

    @classmethod
    def none(cls, k: int) -> Best:
        return cls(k, np.empty(0, np.int64), np.empty(0, object))

    def worst(self) -> int:
        """The kth score; -1 while there are fewer."""
        return int(self.scores[-1]) if len(self.scores) == self.k else -1

    def take(self, scores: np.ndarray, keys: np.ndarray) -> None:
        good = scores >= max(self.worst(), 1)
        scores = np.concatenate([self.scores, scores[good]])
        keys = np.concatenate([self.keys, keys[good]])
        order = sorted(range(len(scores)), key=lambda i: (-scores[i], keys[i] is None, keys[i]))[: self.k]
        self.scores, self.keys = scores[order], keys[order]


class ImpactLists:
    """Impact lists and the forward index of a block.

    ``docs, terms, impacts`` are parallel arrays of postings, by document; ``keys`` has the
    id of each document. Impacts are positive.
    """

    def __init__(self, docs: np.ndarray, terms: np.ndarray, impacts: np.ndarray, keys: np.ndarray, n_terms: int):
        self.keys, self.terms, self.impacts = keys, terms, impacts
        self.doc_starts = np.searchsorted(docs, np.arange(len(keys) + 1))
        order = np.lexsort((docs, -impacts, terms))
        self.list_starts = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.list_docs, self.list_impacts = docs[order], impacts[order]
        self.positions = np.empty(len(order), dtype=np.int64)
        self.positions[order] = np.arange(len(order))
        self._slot = np.full(n_terms, -1, dtype=np.int64)
        self._seen = np.zeros(len(order), dtype=bool)
        self._met = np.zeros(len(keys), dtype=bool)

    def _postings(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers of the postings of documents, and which of them each belongs to."""
        starts, sizes = self.doc_starts[found], self.doc_starts[found + 1] - self.doc_starts[found]
        owner = np.repeat(np.arange(len(found)), sizes)
        first = np.cumsum(sizes) - sizes
        return starts[owner] + np.arange(len(owner)) - first[owner], owner

    def search(self, query: np.ndarray, best: Best) -> None:
        """Add to ``best`` the block's documents with positive scores for the query's terms.

        Stops when the bound of the documents not met is strictly below the kth score, so
        none that ties with it is missed; ``best`` may come from other blocks.
        """
        starts, ends = self.list_starts[query], self.list_starts[query + 1]
        own = starts < ends
        query, starts, ends = query[own], starts[own], ends[own]
        if not len(query):
            return
        self._slot[query] = np.arange(len(query))
        touched_docs, touched_positions = [], []
        at = starts.copy()
        while len(at):
            going = at < ends
            # What any document not met can add in a list is the impact at its first unseen position.
            bound = int(self.list_impacts[at[going]].sum())
            if not bound or bound < best.worst():
                break
            reads = (at[going][:, None] + np.arange(STEP)).ravel()
            reads = reads[reads < np.repeat(ends[going], STEP)]
            found = np.unique(self.list_docs[reads])
            found = found[~self._met[found]]
            rows, owner = self._postings(found)
            asked = self._slot[self.terms[rows]] >= 0
            rows, owner = rows[asked], owner[asked]
            self._met[found] = True
            seen = self.positions[rows]
            self._seen[seen] = True
            touched_docs.append(found)
            touched_positions.append(seen)
            scores = np.zeros(len(found), dtype=np.int64)
            np.add.at(scores, owner, self.impacts[rows])
            best.take(scores, self.keys[found])
            best.met += len(found)
            at = self._advanced(at, ends)
        for found, seen in zip(touched_docs, touched_positions, strict=True):
            self._met[found] = False
            self._seen[seen] = False
        self._slot[query] = -1

    def _advanced(self, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The first unseen position of each list, or its end."""
        at = at.copy()
        moving = np.flatnonzero(at < ends)
        width = 2 * STEP
        while len(moving):
            spots = at[moving][:, None] + np.arange(width)
            inside = spots < ends[moving][:, None]
            unseen = ~self._seen[np.minimum(spots, len(self._seen) - 1)] | ~inside
            stop = unseen.any(axis=1)
            at[moving] += np.where(stop, unseen.argmax(axis=1), width)
            moving = moving[~stop]
        return at
