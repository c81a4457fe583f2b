"""A linear-chain conditional random field whose labels share emission weights, fitted by maximum likelihood."""

from __future__ import annotations

import numpy as np

FORBIDDEN = -1e4


class Layout:
    """Sequences laid end to end, longest first, so that step t of all that are so long can be computed at once."""

    def __init__(self, sizes: list[int]):
        n = np.array(sizes, np.int64)
        self.order = np.argsort(-n, kind="stable")
        self.order = self.order[n[self.order] > 0]
        self.n = n[self.order]
        self.first = np.cumsum(np.r_[0, self.n])[:-1]
        self.live = [int(np.searchsorted(-self.n, -t, "left")) for t in range(int(self.n[0]) if len(self.n) else 0)]

    def gather(self, parts: list[np.ndarray]) -> np.ndarray:
        return np.concatenate([parts[i] for i in self.order])

    def split(self, flat: np.ndarray, of: list) -> list:
        """flat's stretches in the place of the sequences that they belong to; `of` holds the rest."""
        for j, i in enumerate(self.order):
            of[i] = flat[self.first[j] : self.first[j] + self.n[j]]
        return of


class Chain:
    """gain[y] says how much of the emission score (sum of w over a position's features) label y receives."""

    def __init__(self, gain: np.ndarray, w: np.ndarray, trans: np.ndarray, start: np.ndarray):
        self.gain, self.w, self.trans, self.start = gain, w, trans, start

    def _expect(self, x: np.ndarray, to: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of each label at each position, of each pair of labels at each but the first ones; and those positions."""
        k = len(self.gain)
        emit = np.exp(np.clip(self.w[x].sum(1), -30, 30)[:, None] * self.gain)
        move, begin = np.exp(self.trans), np.exp(self.start)
        alpha, beta, z = np.empty((len(x), k)), np.ones((len(x), k)), np.empty(len(x))
        for t, c in enumerate(to.live):
            at = to.first[:c] + t
            f = emit[at] * (alpha[at - 1] @ move if t else begin)
            z[at] = f.sum(1)
            alpha[at] = f / z[at][:, None]
        for t in range(len(to.live) - 2, -1, -1):
            at = to.first[: to.live[t + 1]] + t
            beta[at] = (emit[at + 1] * beta[at + 1] / z[at + 1][:, None]) @ move.T
        inner = np.ones(len(x), bool)
        inner[to.first] = False
        pair = np.flatnonzero(inner)
        xi = (alpha[pair - 1][:, :, None] * move) * (emit[pair] * beta[pair] / z[pair][:, None])[:, None, :]
        return alpha * beta, xi, pair

    @classmethod
    def fit(cls, seqs: list[tuple[np.ndarray, np.ndarray]], n_features: int, gain: np.ndarray, allowed: np.ndarray, starts: np.ndarray, steps: int = 150, l2: float = 1e-3, rate: float = 0.15, since: Chain | None = None) -> Chain:
        """seqs: (feature numbers [positions, fields], labels [positions]); allowed: transitions that may occur; since: where to begin."""
        k = len(gain)
        ban, ban_start = np.where(allowed, 0.0, FORBIDDEN), np.where(starts, 0.0, FORBIDDEN)
        seqs = [s for s in seqs if len(s[1])]
        if not seqs:
            return cls(gain, np.zeros(n_features), ban, ban_start)
        to = Layout([len(s[1]) for s in seqs])
        x, y = to.gather([s[0] for s in seqs]), to.gather([s[1] for s in seqs]).astype(np.int64)
        inner = np.ones(len(y), bool)
        inner[to.first] = False
        pair = np.flatnonzero(inner)
        seen_w = np.bincount(x.ravel(), np.repeat(gain[y], x.shape[1]), n_features)
        seen_t, seen_s = np.bincount(k * y[pair - 1] + y[pair], minlength=k * k).astype(float), np.bincount(y[to.first], minlength=k).astype(float)
        p = np.concatenate([since.w, (since.trans - ban).ravel(), since.start - ban_start]) if since else np.zeros(n_features + k * k + k)
        m, v = np.zeros_like(p), np.zeros_like(p)
        now = cls(gain, p[:n_features], ban, ban_start)
        for step in range(1, steps + 1):
            now = cls(gain, p[:n_features], p[n_features : n_features + k * k].reshape(k, k) + ban, p[-k:] + ban_start)
            post, xi, _ = now._expect(x, to)
            grad = np.concatenate([np.bincount(x.ravel(), np.repeat(post @ gain, x.shape[1]), n_features) - seen_w, xi.sum(0).ravel() - seen_t, post[to.first].sum(0) - seen_s]) / len(y) + l2 * p
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            p = p - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return cls(gain, p[:n_features].copy(), p[n_features : n_features + k * k].reshape(k, k) + ban, p[-k:] + ban_start)

    def posteriors(self, feats: list[np.ndarray]) -> list[np.ndarray]:
        """Probability of each label at each position of each sequence."""
        to, out = Layout([len(f) for f in feats]), [np.empty((0, len(self.gain)))] * len(feats)
        return to.split(self._expect(to.gather(feats), to)[0], out) if len(to.n) else out

    def margin(self) -> float:
        """If the emission score of a position is below minus this, label 0 is on the best path there whatever stands
        around it, given that only emission scores and allowed transitions count: giving it label 0 moves two
        transitions, and a third where what follows must then begin anew."""
        open_ = self.trans[self.trans > FORBIDDEN / 2]
        begin = self.start[self.start > FORBIDDEN / 2]
        return 3 * float(open_.max() - open_.min()) + float(begin.max() - begin.min())

    def viterbi(self, score: np.ndarray) -> np.ndarray:
        """Best labels for the emission scores of one sequence; ties go to the smaller label."""
        return self.viterbi_all([score])[0]

    def viterbi_all(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """The same for many sequences at once: step t of all that are so long."""
        to, k = Layout([len(s) for s in scores]), len(self.gain)
        out = [np.empty(0, np.int8)] * len(scores)
        if not len(to.n):
            return out
        gain = to.gather(scores)[:, None] * self.gain
        came, best = np.zeros((len(gain), k), np.int8), np.empty((len(to.n), k))
        for t, c in enumerate(to.live):
            at = to.first[:c] + t
            if t:
                top, from_ = best[:c, :1] + self.trans[0], np.zeros((c, k), np.int8)
                for y in range(1, k):
                    other = best[:c, y : y + 1] + self.trans[y]
                    more = other > top
                    top[more], from_[more] = other[more], y
                came[at], best[:c] = from_, top
            else:
                best[:c] = self.start
            best[:c] += gain[at]
        tags, now = np.empty(len(gain), np.int8), best.argmax(1)
        for t in range(len(to.live) - 1, -1, -1):
            c = to.live[t]
            at = to.first[:c] + t
            tags[at] = now[:c]
            if t:
                now[:c] = came[at, now[:c]]
        return to.split(tags, out)
