"""A group of documents meets all queries: blocks that can hold one of a query's best sessions are scored, and only its best sessions in the group go on.

What a meeting gives grows with queries times groups, not with the documents that match; pairs of query and document or block are never rows of a table.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

UNIT = float(1 << 40)


def places(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each start, so many as its length says, one after the other."""
    return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())


class Group:
    """Postings (tid, doc, block, weight), documents (doc, session_id). Documents are numbered by block, then number, so one order of a term's postings has both its blocks and its documents in order."""

    def __init__(self, postings: pa.Table, docs: pa.Table) -> None:
        own = docs["doc"].to_numpy()
        order = np.argsort(own, kind="stable")
        ids = own[order]
        at = np.searchsorted(ids, postings["doc"].to_numpy())
        block_of = np.zeros(len(ids), np.int32)
        block_of[at] = postings["block"].to_numpy()
        by_block = np.lexsort((ids, block_of))
        place = np.empty(len(ids), np.int32)
        place[by_block] = np.arange(len(ids), dtype=np.int32)
        at, self.rows, self.docs, block_of = place[at], order[by_block], ids[by_block], block_of[by_block]
        sessions = docs["session_id"].combine_chunks().dictionary_encode()
        rank = np.empty(len(sessions.dictionary), np.int64)
        rank[pc.sort_indices(sessions.dictionary).to_numpy()] = np.arange(len(rank))
        codes = sessions.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        self.session = np.where(codes < 0, len(rank), rank[codes] if len(rank) else 0)[self.rows]  # in order of sessions
        self.n_sessions = len(rank) + 1
        tid = postings["tid"].to_numpy()
        self.terms = np.unique(tid)
        term = np.searchsorted(self.terms, tid).astype(np.int32)
        del tid
        order = np.argsort(term * np.int64(len(ids)) + at)
        self.at, self.weight = at[order], postings["weight"].to_numpy()[order]
        self.start = np.r_[0, np.cumsum(np.bincount(term, minlength=len(self.terms)))]  # of a term's postings
        term, block = term[order], block_of[self.at]
        new = np.flatnonzero(np.r_[len(term) > 0, (term[1:] != term[:-1]) | (block[1:] != block[:-1])])
        self.block, self.begin, self.size = block[new], new, np.diff(np.r_[new, len(term)])
        self.most = np.maximum.reduceat(self.weight, new) if len(new) else self.weight
        self.first = np.searchsorted(new, self.start)  # of a term's blocks

    def asked(self, parts: pa.ChunkedArray) -> list[np.ndarray | None]:
        """Lists of tids as places among the terms, none where the group lacks one of them."""
        tids, ends = pc.list_flatten(parts).to_numpy(), np.cumsum(pc.list_value_length(parts).to_numpy(), dtype=np.int64)
        code = np.searchsorted(self.terms, tids)
        lacks = code == len(self.terms)
        lacks[~lacks] = self.terms[code[~lacks]] != tids[~lacks]
        lacking = np.r_[0, np.cumsum(lacks)]
        return [code[a:b] if lacking[a] == lacking[b] else None for a, b in zip(np.r_[0, ends[:-1]], ends)]

    def possible(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Blocks that have every term, as places among those of the first (rarest) one; the most that a document in them can score, and their postings."""
        a, b = self.first[parts[0]], self.first[parts[0] + 1]
        mine = np.arange(a, b)
        bound, n = self.most[a:b], self.size[a:b]
        for t in parts[1:]:
            a, b = self.first[t], self.first[t + 1]
            here = a + np.searchsorted(self.block[a:b], self.block[mine])
            has = here < b
            has[has] = self.block[here[has]] == self.block[mine[has]]
            here, mine = here[has], mine[has]
            bound, n = bound[has] + self.most[here], n[has] + self.size[here]
        return mine, bound, n

    def score(self, parts: np.ndarray, mine: np.ndarray, limit: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Documents of some blocks with every term, and their scores, summed as search.exact_sum() does; of sessions over the limit, none need be there."""
        ix = places(self.begin[mine], self.size[mine])
        at, found = self.at[ix], [ix]
        for t in parts[1:]:
            own = self.at[self.start[t] : self.start[t + 1]]
            here = np.searchsorted(own, at)
            has = own.take(here, mode="clip") == at
            at, found = at[has], [*(f[has] for f in found), here[has] + self.start[t]]
        if limit is not None and limit < self.n_sessions and len(at) > limit:
            # Sums as they come are near enough to tell which can't be among the best.
            near, top = sum(self.weight[f] for f in found), np.full(self.n_sessions, -np.inf)
            np.maximum.at(top, self.session[at], near)
            some = near >= np.partition(top, self.n_sessions - limit)[self.n_sessions - limit] - 1e-9
            at, found = at[some], [f[some] for f in found]
        whole = rest = np.zeros(len(at), np.int64)
        for f in found:
            more = split(self.weight[f])
            whole, rest = whole + more[0], rest + more[1]
        return at, (whole + rest / UNIT) / UNIT

    def best(self, at: np.ndarray, score: np.ndarray, limit: int | None) -> tuple[np.ndarray, np.ndarray]:
        """The best document of each session, smaller ones first among equals, and the `limit` best sessions, in order."""
        if not len(at):
            return at, score
        session = self.session[at]
        top = np.full(self.n_sessions, -np.inf)
        np.maximum.at(top, session, score)
        held = score == top[session]
        if limit is not None and limit < self.n_sessions:
            held &= score >= np.partition(top, self.n_sessions - limit)[self.n_sessions - limit]
        at, score, session = at[held], score[held], session[held]
        order = np.lexsort((self.docs[at], session, -score))  # equal scores of a session lie together
        at, score, session = at[order], score[order], session[order]
        once = np.r_[True, session[1:] != session[:-1]]
        return at[once][:limit], score[once][:limit]


def split(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    whole = np.floor(x * UNIT)
    return whole.astype(np.int64), np.floor((x * UNIT - whole) * UNIT).astype(np.int64)


def meeting(limit: int | None, probe: int, tell_read: bool, schema: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For cogroups of postings with documents (doc, session_id) and queries (qid, parts: tids, the rarest first): qid, session_id, doc, score, or qid, block, postings.

    The `probe` blocks of highest bound are scored first. Their score at rank `limit` is a floor; of the others, blocks whose bound reaches it are read.
    """

    def meet(postings: pa.Table, others: pa.Table) -> pa.Table:
        is_doc = pc.is_valid(others["doc"])
        docs, asked = others.filter(is_doc), others.filter(pc.invert(is_doc))
        group = Group(postings, docs)
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        for i, parts in enumerate(group.asked(asked["parts"])):
            if parts is None:
                continue
            mine, bound, n = group.possible(parts)
            order = np.argsort(-bound, kind="stable") if len(mine) > probe and limit is not None else np.arange(len(mine))
            first, rest = order[:probe], order[probe:]
            at, score = group.best(*group.score(parts, mine[first], limit), limit)
            if len(rest):
                if limit is not None and len(at) == limit:
                    rest = rest[bound[rest] >= score[-1] - 1e-9]
                more = group.score(parts, mine[rest], limit)
                at, score = group.best(np.r_[at, more[0]], np.r_[score, more[1]], limit)
            if tell_read:
                both = np.r_[first, rest]
                found.append((i, group.block[mine[both]], n[both]))
            else:
                found.append((i, at, score))
        whole = lambda k, kind: np.concatenate([np.zeros(0, kind), *[f[k] for f in found]]).astype(kind)
        who = asked["qid"].take(pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int64)))
        if tell_read:
            return pa.table([who, pa.array(whole(1, np.int64)), pa.array(whole(2, np.int64))], ["qid", "block", "postings"]).cast(schema)
        own = pa.array(group.rows[whole(1, np.int64)])
        return pa.table([who, docs["session_id"].take(own), docs["doc"].take(own), pa.array(whole(2, np.float64))], ["qid", "session_id", "doc", "score"]).cast(schema)

    return meet
