"""A robust-pruned directed graph over unit vectors: greedy searches propose neighbours, relaxed pruning keeps diverse edges.

All steps work on blocks of points at once, so the cost is that of NumPy gathers and not of a Python loop over points.
"""

from __future__ import annotations

import numpy as np


class RobustGraph:
    def __init__(self, x: np.ndarray, degree: int = 12, beam: int = 20, alpha: float = 1.6, block: int = 1024, seed: int = 11, entries: int = 8):
        self.x = np.ascontiguousarray(x, np.float32)
        self.degree, self.beam, self.alpha, self.block, self.entries = degree, beam, alpha, block, entries
        n = len(x)
        self.out = np.full((n, degree), -1, np.int32)
        rng = np.random.default_rng(seed)
        self._build(rng.permutation(n).astype(np.int32))

    # building -------------------------------------------------------------------------------------------------------

    def _build(self, order: np.ndarray) -> None:
        n, done = len(order), min(len(order), 64)
        self.hubs = order[: max(1, done)]
        first = order[:done]
        if done > 1:  # the first points see each other
            near = np.broadcast_to(first, (done, done))
            self._insert(first, near, self.x[first] @ self.x[first].T)
        while done < n:
            size = min(self.block, max(64, done // 2), n - done)
            new = order[done : done + size]
            self.hubs = order[: self._hubs(done)]
            ids, sims = self.search(self.x[new], beam=self.beam)
            mates = self.x[new] @ self.x[new].T  # points that come together see each other
            k = min(self.beam, size)
            top = np.argpartition(-mates, k - 1, axis=1)[:, :k]
            self._insert(new, np.concatenate([ids, new[top]], 1), np.concatenate([sims, np.take_along_axis(mates, top, 1)], 1))
            done += size
        self.hubs = order[: self._hubs(n)]

    def _hubs(self, n: int) -> int:
        """Points among which a search looks for its entries: in many small groups far from each other a few would not lead everywhere."""
        return min(n, max(64, n // 8))

    def _insert(self, new: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        self.out[new] = self._prune(new, ids, sims)
        src, dst = np.repeat(new, self.degree), self.out[new].ravel()
        ok = dst >= 0
        src, dst = src[ok], dst[ok]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        who, start, count = np.unique(dst, return_index=True, return_counts=True)
        rank = np.arange(len(dst)) - np.repeat(start, count)
        place = np.repeat(np.arange(len(who)), count)
        wide = 2 * self.degree
        for low in range(0, int(count.max(initial=0)), wide):  # a node of many back edges takes them in several rounds
            some = np.nonzero(count > low)[0]
            at = np.full(len(who), -1)
            at[some] = np.arange(len(some))
            keep = (rank >= low) & (rank < low + wide)
            added = np.full((len(some), int(min(count.max() - low, wide))), -1, np.int32)
            added[at[place[keep]], rank[keep] - low] = src[keep]
            self._back(who[some], added)

    def _back(self, who: np.ndarray, added: np.ndarray) -> None:
        both = np.concatenate([self.out[who], added], 1)
        free = (both >= 0).sum(1) <= self.degree
        if free.any():
            f = both[free]
            self.out[who[free]] = np.take_along_axis(f, np.argsort(f < 0, axis=1, kind="stable"), 1)[:, : self.degree]
        full = np.nonzero(~free)[0]
        for i in range(0, len(full), self.block):
            w = who[full[i : i + self.block]]
            c = both[full[i : i + self.block]]
            s = np.matmul(self.x[np.maximum(c, 0)], self.x[w][:, :, None])[:, :, 0]
            self.out[w] = self._prune(w, c, np.where(c >= 0, s, -9))

    def _prune(self, who: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> np.ndarray:
        """Robust pruning: take the nearest candidate, drop those that it covers by the factor ``alpha``, go on."""
        sims = np.where((ids < 0) | (ids == who[:, None]), -9, sims)
        order = np.argsort(-sims, axis=1)
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        alive = sims > -2
        v = self.x[np.maximum(ids, 0)]
        gap = self.alpha * (1 - np.matmul(v, v.transpose(0, 2, 1)))
        own = 1 - sims
        kept, rows = np.full((len(who), self.degree), -1, np.int32), np.arange(len(who))
        for r in range(self.degree):
            pick = alive.argmax(1)
            some = alive[rows, pick]
            if not some.any():
                break
            kept[:, r] = np.where(some, ids[rows, pick], -1)
            alive &= gap[rows, pick] > own
            alive[rows, pick] = False
        return kept

    # searching ------------------------------------------------------------------------------------------------------

    def search(self, q: np.ndarray, beam: int | None = None, entry: np.ndarray | None = None, expand: int = 3) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of every row of ``q``: ids and cosines, best first; -1 where the beam is not filled."""
        beam = beam or self.beam
        ids_out = np.full((len(q), beam), -1, np.int32)
        sims_out = np.full((len(q), beam), -9, np.float32)
        for i in range(0, len(q), self.block):
            e = None if entry is None else entry[i : i + self.block]
            ids_out[i : i + self.block], sims_out[i : i + self.block] = self._block(np.ascontiguousarray(q[i : i + self.block], np.float32), beam, e, expand)
        return ids_out, sims_out

    def _block(self, q: np.ndarray, beam: int, entry: np.ndarray | None, expand: int) -> tuple[np.ndarray, np.ndarray]:
        b = len(q)
        hub = q @ self.x[self.hubs].T
        k = min(self.entries, len(self.hubs))
        top = np.argpartition(-hub, k - 1, axis=1)[:, :k]
        start, s0 = self.hubs[top].astype(np.int32), np.take_along_axis(hub, top, 1)
        if entry is not None:
            own = np.einsum("bd,bd->b", self.x[np.maximum(entry, 0)], q)
            start = np.concatenate([start, entry[:, None].astype(np.int32)], 1)
            s0 = np.concatenate([s0, np.where(entry >= 0, own, -9)[:, None].astype(np.float32)], 1)
        ids, sims = np.full((b, beam), -1, np.int32), np.full((b, beam), -9, np.float32)
        open_ = np.zeros((b, beam), bool)
        seen = np.zeros((b, len(self.x)), bool)
        m = min(start.shape[1], beam)
        order = np.argsort(-s0, axis=1)[:, :m]
        ids[:, :m], sims[:, :m] = np.take_along_axis(start, order, 1), np.take_along_axis(s0, order, 1)
        twice = np.zeros((b, m), bool)
        for j in range(1, m):
            twice[:, j] = (ids[:, :j] == ids[:, j : j + 1]).any(1)
        bad = twice | (sims[:, :m] < -2)
        ids[:, :m][bad], sims[:, :m][bad] = -1, -9
        open_[:, :m] = ~bad
        rows = np.arange(b)
        seen[np.repeat(rows, m), np.maximum(ids[:, :m].ravel(), 0)] |= (ids[:, :m] >= 0).ravel()
        active = rows
        place = np.arange(beam)
        while len(active):
            o = np.where(open_[active], place, beam)
            sel = np.partition(o, expand - 1, axis=1)[:, :expand] if expand < beam else o
            live = sel < beam
            at = np.minimum(sel, beam - 1)
            lr, lc = np.nonzero(live)
            open_[active[lr], at[lr, lc]] = False
            node = np.where(live, ids[active[:, None], at], -1)
            nb = np.where(node[:, :, None] >= 0, self.out[np.maximum(node, 0)], -1).reshape(len(active), -1)
            fresh = (nb >= 0) & ~seen[active[:, None], np.maximum(nb, 0)]
            r, c = np.nonzero(fresh)
            got = nb[r, c]
            seen[active[r], got] = True
            s = np.full(nb.shape, -9, np.float32)
            s[r, c] = np.einsum("nd,nd->n", self.x[got], q[active[r]])
            all_i = np.concatenate([ids[active], nb], 1)
            all_s = np.concatenate([sims[active], s], 1)
            all_o = np.concatenate([open_[active], fresh], 1)
            part = np.argpartition(-all_s, beam, axis=1)[:, : beam + expand] if all_s.shape[1] > beam + expand else np.broadcast_to(np.arange(all_s.shape[1]), all_s.shape)
            ps = np.take_along_axis(all_s, part, 1)
            order = np.take_along_axis(part, np.argsort(-ps, axis=1), 1)
            i2, s2, o2 = (np.take_along_axis(a, order, 1) for a in (all_i, all_s, all_o))
            same = np.zeros(i2.shape, bool)
            same[:, 1:] = (i2[:, 1:] == i2[:, :-1]) & (s2[:, 1:] > -2)
            if same.any():
                s2[same], o2[same] = -9, False
                order = np.argsort(-s2, axis=1, kind="stable")
                i2, s2, o2 = (np.take_along_axis(a, order, 1) for a in (i2, s2, o2))
            i2, s2, o2 = i2[:, :beam], s2[:, :beam], o2[:, :beam] & (s2[:, :beam] > -2)
            i2[s2 < -2] = -1
            ids[active], sims[active], open_[active] = i2, s2, o2
            active = active[o2.any(1)]
        return ids, sims
