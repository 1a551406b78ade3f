"""A character-level bidirectional LSTM with CRF transitions, in numpy: training and decoding.

Inputs are character classes (ASCII letters without case, digits as one, each
mark, white space, all else), so the input layer is a table lookup. Both
directions run as one stacked array. Tags are O, and B and I of each kind; the
CRF allows I only behind B or I of its kind. Decoding skips the best-path search
where no path can beat "O everywhere", which is a bound and not a guess.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Score of a step that BIO forbids: when decoding, and when training. The milder one makes emissions of I
#: low in plain text, where they would be free otherwise, so that the bound of ``paths`` holds there.
_NEVER, _SELDOM = np.float32(-1e4), np.float32(-6)


BLANK = 28


def _classes() -> np.ndarray:
    """Class of each ASCII code point, and at 128 that of all others."""
    table = np.zeros(129, np.uint8)
    marks = [c for c in range(33, 127) if not chr(c).isalnum()]
    for c in range(128):
        ch = chr(c)
        if ch.isalpha():
            table[c] = 1 + ord(ch.lower()) - ord("a")
        elif ch.isdigit():
            table[c] = 27
        elif ch == " ":
            table[c] = BLANK
        elif c in marks:
            table[c] = 30 + marks.index(c)
        else:
            table[c] = 29
    table[128] = 30 + len(marks)
    return table


CLASS = _classes()
N_CLASSES = int(CLASS.max()) + 1


def symbols(text: str) -> np.ndarray:
    """A class for each code point."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return CLASS[np.minimum(points, 128)]


def tags_of(kinds: tuple[str, ...]) -> list[str]:
    return ["O", *(f"{p}-{k}" for k in kinds for p in "BI")]


def encode_tags(length: int, spans: list[tuple[str, int, int]], kinds: tuple[str, ...]) -> np.ndarray:
    y = np.zeros(length, np.int64)
    for kind, start, end in spans:
        y[start] = 1 + 2 * kinds.index(kind)
        y[start + 1 : end] = 2 + 2 * kinds.index(kind)
    return y


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


@dataclass
class Tagger:
    """e (2, classes, 4h), u (2, h, 4h), w (2, h, tags), b (tags), trans (tags, tags), first (tags), last (tags).

    Gate columns are input, forget, output, and candidate. A gate is 1 + tanh, twice the usual one, so that one tanh
    serves all columns; the cell halves what they let through, and the output's double is left to the weights.
    """

    kinds: tuple[str, ...]
    p: dict[str, np.ndarray]

    @staticmethod
    def fresh(kinds: tuple[str, ...], hidden: int, seed: int) -> Tagger:
        rng = np.random.default_rng(seed)
        t = 1 + 2 * len(kinds)
        p = {
            "e": rng.normal(0, 0.3, (2, N_CLASSES, 4 * hidden)),
            "u": rng.normal(0, 1 / np.sqrt(hidden), (2, hidden, 4 * hidden)) * 0.5,
            "w": rng.normal(0, 1 / np.sqrt(hidden), (2, hidden, t)),
            "b": np.zeros(t),
            "trans": np.zeros((t, t)),
            "first": np.zeros(t),
            "last": np.zeros(t),
        }
        p["e"][:, :, hidden : 2 * hidden] += 0.5  # forget little at first
        return Tagger(kinds, {k: v.astype(np.float32) for k, v in p.items()})

    def _allowed(self, forbidden: np.float32 = _NEVER, trans: np.ndarray | None = None, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Transitions and first scores (the tagger's own, or those given), with what BIO forbids at that score."""
        trans, first = (self.p["trans"] if trans is None else trans).copy(), (self.p["first"] if first is None else first).copy()
        for k in range(len(self.kinds)):
            inside = 2 + 2 * k
            out = np.ones(len(first), bool)
            out[[inside - 1, inside]] = False
            trans[out, inside] = forbidden
            first[inside] = forbidden
        return trans, first

    def emissions(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """(steps, tags, rows) for classes x (rows, steps), all rows of one length. keep: receives what the way back needs.

        Rows are the last axis throughout, so each gate is one run of memory and a step stays within the cache.
        """
        n, steps = x.shape
        hid = self.p["u"].shape[1]
        e = self.p["e"].reshape(2 * N_CLASSES, 4 * hid)
        u, w = (np.ascontiguousarray(self.p[k].transpose(0, 2, 1)) for k in ("u", "w"))
        both = np.stack([x.T, x.T[::-1]], axis=1).astype(np.intp)  # (steps, 2, rows)
        both[:, 1] += N_CLASSES
        dtype = e.dtype
        h, c, tmp = (np.zeros((2, hid, n), dtype) for _ in range(3))
        seen, z = np.empty((2, n, 4 * hid), dtype), np.empty((2, 4 * hid, n), dtype)
        out = np.empty((steps, 2, w.shape[1], n), dtype)
        for t in range(steps):
            before = (h.copy(), c.copy()) if keep is not None else None
            np.take(e, both[t], axis=0, out=seen, mode="clip")
            np.matmul(u, h, out=z)
            z += seen.transpose(0, 2, 1)
            np.tanh(z, out=z)
            z[:, : 3 * hid] += 1  # gates lie between 0 and 2
            c *= z[:, hid : 2 * hid]
            np.multiply(z[:, :hid], z[:, 3 * hid :], out=tmp)
            c += tmp
            c *= 0.5
            np.tanh(c, out=tmp)
            np.multiply(z[:, 2 * hid : 3 * hid], tmp, out=h)
            np.matmul(w, h, out=out[t])
            if keep is not None:
                keep.append((both[t], *before, z.copy(), tmp.copy(), h.copy()))
        em = out[:, 0]
        em += out[::-1, 1]
        em += self.p["b"][:, None]
        return em

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood a row of the tags y (rows, steps), and its gradient."""
        keep: list = []
        em = np.ascontiguousarray(self.emissions(x, keep).transpose(0, 2, 1))
        steps, n, _ = em.shape
        trans, first = self._allowed(_SELDOM)
        last = self.p["last"]
        alpha, beta = np.empty_like(em), np.empty_like(em)
        alpha[0] = first + em[0]
        for s in range(1, steps):
            alpha[s] = _lse(alpha[s - 1][:, :, None] + trans, 1) + em[s]
        beta[-1] = last
        for s in range(steps - 2, -1, -1):
            beta[s] = _lse(trans + (em[s + 1] + beta[s + 1])[:, None, :], 2)
        z = _lse(alpha[-1] + last, 1)
        rows = np.arange(n)
        gold = first[y[:, 0]] + last[y[:, -1]] + sum(em[s, rows, y[:, s]] for s in range(steps)) + sum(trans[y[:, s], y[:, s + 1]] for s in range(steps - 1))
        d_em = np.exp(alpha + beta - z[None, :, None])
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        for s in range(steps - 1):
            pair = np.exp(alpha[s][:, :, None] + trans + (em[s + 1] + beta[s + 1])[:, None, :] - z[:, None, None])
            g["trans"] += pair.sum(axis=0)
            np.subtract.at(g["trans"], (y[:, s], y[:, s + 1]), 1)
        for s in range(steps):
            d_em[s, rows, y[:, s]] -= 1
        g["first"], g["last"], g["b"] = d_em[0].sum(axis=0), d_em[-1].sum(axis=0), d_em.sum(axis=(0, 1))
        g["trans"], g["first"] = self._allowed(np.float32(0), g["trans"], g["first"])
        d_em = d_em.transpose(0, 2, 1)
        self._back(keep, np.stack([d_em, d_em[::-1]], axis=1), g)
        return float((z - gold).mean()), {k: v / n for k, v in g.items()}

    def _back(self, keep: list, d_out: np.ndarray, g: dict[str, np.ndarray]) -> None:
        """Gradient of the recurrent layers; d_out is (steps, 2, tags, rows) in each direction's own order."""
        hid = self.p["u"].shape[1]
        one_of = np.eye(N_CLASSES, dtype=self.p["e"].dtype)
        d_h = np.zeros_like(keep[0][1])
        d_c = np.zeros_like(d_h)
        for t in range(len(keep) - 1, -1, -1):
            at, h0, c0, z, tc, h1 = keep[t]
            i, f, o, k = (z[:, j * hid : (j + 1) * hid] for j in range(4))
            g["w"] += h1 @ d_out[t].transpose(0, 2, 1)
            d_h = d_h + self.p["w"] @ d_out[t]
            d_c = 0.5 * (d_c + d_h * o * (1 - tc * tc))
            # a gate is tanh + 1: its slope is g (2 - g)
            d_z = np.concatenate([d_c * k * i * (2 - i), d_c * c0 * f * (2 - f), d_h * tc * o * (2 - o), d_c * i * (1 - k * k)], axis=1)
            g["u"] += h0 @ d_z.transpose(0, 2, 1)
            for side in range(2):
                g["e"][side] += (d_z[side] @ one_of[at[side] - side * N_CLASSES]).T
            d_h = self.p["u"] @ d_z
            d_c = d_c * f

    @staticmethod
    def _most_gain(em: np.ndarray, trans: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """For each row no less than what any run of tags other than O can outscore O by; all scores are relative to O's.

        A run opens with a B, and gains at most the best step into it, its best emissions, the best step within it for each further tag, and the best out of it.
        """
        opening, best = em[:, 1::2].max(axis=1), em[:, 1:].max(axis=1)
        into, out, within = max(trans[0, 1:].max(), first[1:].max()), max(trans[1:, 0].max(), last[1:].max()), trans[1:, 1:].max()
        opening -= em[:, 0]
        best -= em[:, 0]
        best += within
        total = np.cumsum(best, axis=0, dtype=np.float64)
        return (total + np.maximum.accumulate(opening - total, axis=0)).max(axis=0) + into + out

    def paths(self, em: np.ndarray) -> dict[int, np.ndarray]:
        """row -> best tags, of the rows whose best path is not O throughout; em is (steps, tags, rows)."""
        trans, first = self._allowed()
        last = self.p["last"]
        open_ = np.flatnonzero(self._most_gain(em, trans - trans[0, 0], first - first[0], last - last[0]) > -0.01)
        if not len(open_):
            return {}
        em = np.ascontiguousarray(em[:, :, open_])
        score = np.empty_like(em)
        score[0] = first[:, None] + em[0]
        each, step = np.empty((len(first), *em.shape[1:]), em.dtype), trans[:, :, None]
        for s in range(1, len(em)):
            np.add(score[s - 1][:, None], step, out=each)
            np.max(each, axis=0, out=score[s])
            score[s] += em[s]
        # the way back finds the best tag before each tag that it takes
        tags = np.empty((len(em), len(open_)), np.uint8)
        tags[-1] = (score[-1] + last[:, None]).argmax(axis=0)
        for s in range(len(em) - 1, 0, -1):
            tags[s - 1] = (score[s - 1] + trans[:, tags[s]]).argmax(axis=0)
        return {int(r): tags[:, i] for i, r in enumerate(open_) if tags[:, i].any()}

    def spans(self, tags: np.ndarray, em: np.ndarray) -> list[tuple[str, int, int, float]]:
        """(kind, start, end, how far its tags outscore O) of a path; em is (steps, tags)."""
        found, more = [], em[np.arange(len(tags)), tags] - em[:, 0]
        for start in np.flatnonzero(tags % 2 == 1):
            end = start + 1
            while end < len(tags) and tags[end] == tags[start] + 1:
                end += 1
            found.append((self.kinds[tags[start] // 2], int(start), int(end), float(more[start:end].sum())))
        return found


def train(tagger: Tagger, x: np.ndarray, y: np.ndarray, steps: int, rows: int = 64, rate: float = 0.02, seed: int = 0) -> list[float]:
    """Adam over random minibatches of x, y (examples, length), the rate falling to zero; the losses."""
    rng = np.random.default_rng(seed)
    m, v = ({k: np.zeros_like(a) for k, a in tagger.p.items()} for _ in range(2))
    losses = []
    for step in range(steps):
        pick = rng.integers(0, len(x), rows)
        value, g = tagger.loss(x[pick], y[pick])
        losses.append(value)
        size = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
        now = rate * min(1, 10 * (step + 1) / steps) * 0.5 * (1 + np.cos(np.pi * step / steps))
        for k, a in g.items():
            a = a * np.float32(min(1, 5 / (size + 1e-9)))
            m[k] = 0.9 * m[k] + 0.1 * a
            v[k] = 0.99 * v[k] + 0.01 * a * a
            fix = np.sqrt(1 - 0.99 ** (step + 1)) / (1 - 0.9 ** (step + 1))
            tagger.p[k] = (tagger.p[k] - now * fix * m[k] / (np.sqrt(v[k]) + 1e-8)).astype(np.float32)
    return losses
