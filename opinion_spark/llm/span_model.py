"""A character-level bidirectional LSTM with CRF transitions, in numpy: training and decoding of labelled windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

KINDS = ("email", "ip", "card", "phone")
#: Tags: outside, then beginning and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
HIDDEN = 12
#: Stretches searched together, those of similar lengths.
SEARCHED_TOGETHER = 2048

#: A character's class: 0 is padding, then the 128 ASCII characters one by one, then other letters, digits and the rest.
CLASSES = 1 + 128 + 3


def classes_of(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.add(code, 1, dtype=np.int64)
    if not text.isascii():
        wide = np.flatnonzero(code >= 128)
        values, place = np.unique(code[wide], return_inverse=True)
        out[wide] = np.array([129 if chr(v).isalpha() else 130 if chr(v).isdigit() else 131 for v in values.tolist()])[place]
    return out


def tags_of(length: int, spans: list[tuple[str, int, int]]) -> np.ndarray:
    out = np.zeros(length, np.int64)
    for kind, start, end in spans:
        tag = 1 + 2 * KINDS.index(kind)
        out[max(start, 0) : end] = tag + 1
        if 0 <= start < length:
            out[start] = tag
    return out


def _allowed() -> np.ndarray:
    """False where an inside tag would have no beginning."""
    out = np.ones((TAGS, TAGS), bool)
    for kind in range(len(KINDS)):
        begin, inside = 1 + 2 * kind, 2 + 2 * kind
        out[:, inside] = False
        out[[begin, inside], inside] = True
    return out


ALLOWED = _allowed()


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class SpanModel:
    """Windows are integer arrays (n, length) of character classes; class 0 pads their ends."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {}
        for side in ("f", "b"):
            self.p[f"{side}x"] = rng.normal(0, 0.3, (CLASSES, 4 * HIDDEN))
            self.p[f"{side}h"] = rng.normal(0, 0.25, (HIDDEN, 4 * HIDDEN))
            bias = np.zeros(4 * HIDDEN)
            bias[HIDDEN : 2 * HIDDEN] = 1
            self.p[f"{side}c"] = bias
        self.p["out"] = rng.normal(0, 0.3, (2 * HIDDEN, TAGS))
        self.p["bias"] = np.zeros(TAGS)
        self.p["move"] = np.zeros((TAGS, TAGS))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _lstm(self, x: np.ndarray, side: str) -> tuple[np.ndarray, list]:
        n, length = x.shape
        kind = self.p["out"].dtype
        h, c = np.zeros((n, HIDDEN), kind), np.zeros((n, HIDDEN), kind)
        states, out = [], np.zeros((length, n, HIDDEN), kind)
        wx, wh, bias = self.p[f"{side}x"], self.p[f"{side}h"], self.p[f"{side}c"]
        order = range(length) if side == "f" else range(length - 1, -1, -1)
        for t in order:
            z = wx[x[:, t]] + h @ wh + bias
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            here = (x[:, t] > 0)[:, None]  # padding leaves the state at rest
            c_new = np.where(here, f * c + i * g, c)
            th = np.tanh(c_new)
            h_new = np.where(here, o * th, h)
            states.append((t, h, c, i, f, o, g, th, here))
            h, c = h_new, c_new
            out[t] = h
        return out, states

    def _lstm_back(self, x: np.ndarray, side: str, states: list, grad: np.ndarray, into: dict) -> None:
        wh = self.p[f"{side}h"]
        dh, dc = np.zeros_like(grad[0]), np.zeros_like(grad[0])
        for t, h, c, i, f, o, g, th, here in reversed(states):
            dh = dh + grad[t]
            d_new = dc + np.where(here, dh * o * (1 - th * th), 0)
            dz = np.concatenate([d_new * g * i * (1 - i), d_new * c * f * (1 - f), dh * th * o * (1 - o), d_new * i * (1 - g * g)], 1)
            dz = np.where(here, dz, 0)
            into[f"{side}x"] += (x[:, t][None, :] == np.arange(CLASSES)[:, None]).astype(dz.dtype) @ dz
            into[f"{side}h"] += h.T @ dz
            into[f"{side}c"] += dz.sum(0)
            dc = np.where(here, d_new * f, dc)
            dh = np.where(here, 0, dh) + dz @ wh.T

    def _emissions(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        forward, fs = self._lstm(x, "f")
        backward, bs = self._lstm(x, "b")
        both = np.concatenate([forward, backward], 2)
        return both @ self.p["out"] + self.p["bias"], (both, fs, bs)

    def _forward_backward(self, e: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log partition (n), tag marginals (length, n, tags), and per tag pair the expected number of moves. Each step is
        scaled to sum to one; a window may begin inside a span, so any tag may come first."""
        length, n, _ = e.shape
        top = e.max(2)
        weight = np.exp(e - top[:, :, None])
        move = np.where(ALLOWED, np.exp(self.p["move"]), 0).astype(e.dtype)
        a, scale = np.empty_like(e), np.ones((length, n), e.dtype)
        for t in range(length):
            on = (x[:, t] > 0)[:, None]
            step = (a[t - 1] @ move) * weight[t] if t else weight[t]
            total = step.sum(1, keepdims=True)
            a[t] = np.where(on, step / total, a[t - 1] if t else 1 / TAGS)
            scale[t] = np.where(on, total, 1)[:, 0]
        marginal, moves = np.empty_like(e), np.zeros_like(move)
        b = np.ones_like(e[0])
        for t in range(length - 1, -1, -1):
            marginal[t] = a[t] * b
            if t:
                on = (x[:, t] > 0)[:, None]
                later = np.where(on, weight[t] * b / scale[t][:, None], 0)
                moves += (a[t - 1].T @ later) * move
                b = np.where(on, later @ move.T, b)
        z = (np.log(scale) + np.where(x.T > 0, top, 0)).sum(0)
        return z, marginal, moves

    def loss_and_gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of the tags of the windows' characters, and its gradient."""
        n, length = x.shape
        e, (both, fs, bs) = self._emissions(x)
        z, grad_e, grad_move = self._forward_backward(e, x)
        real = x > 0
        rows, steps = np.arange(n)[:, None], np.arange(length)[None, :]
        follow = real[:, 1:]
        before, after = y[:, :-1][follow], y[:, 1:][follow]
        gold = np.where(real, e[steps, rows, y], 0).sum() + self.p["move"][before, after].sum()
        grad_e[steps, rows, y] -= 1
        grad_e = np.where(real.T[:, :, None], grad_e, 0) / n
        np.add.at(grad_move, (before, after), -1)
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        grad["move"] = grad_move / n
        grad["out"] = both.reshape(-1, 2 * HIDDEN).T @ grad_e.reshape(-1, TAGS)
        grad["bias"] = grad_e.sum((0, 1))
        grad_both = grad_e @ self.p["out"].T
        self._lstm_back(x, "f", fs, grad_both[:, :, :HIDDEN], grad)
        self._lstm_back(x, "b", bs, grad_both[:, :, HIDDEN:], grad)
        return float((z.sum() - gold) / n), grad

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 250, batch: int = 48, rate: float = 0.02, seed: int = 7) -> SpanModel:
        """Adam over random batches; the sum of the gradient's squares is bounded."""
        if not len(x):
            return self
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(x), min(batch, len(x)))
            _, grad = self.loss_and_gradient(x[pick], y[pick])
            norm = np.sqrt(sum((g * g).sum() for g in grad.values()))
            scale = min(1.0, 5 / (norm + 1e-9))
            now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, g in grad.items():
                g = g * scale
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                self.p[k] -= now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def _steps(self, x: np.ndarray, side: str) -> Iterator[tuple[int, np.ndarray]]:
        """Twice the hidden states of ``_lstm``, as (step, array of windows by units) without what training keeps; an array is used
        again by the next step. A gate is one stretch of memory, so a character's part of it is one copy of a row. All gates of a step take
        one hyperbolic tangent, a sigmoid of v being (1 + tanh(v / 2)) / 2; the halves are left to the weights."""
        n, length = x.shape
        kind = self.p["out"].dtype
        by = np.where(np.arange(4 * HIDDEN) < 3 * HIDDEN, 0.5, 1).astype(kind)

        def by_gate(weights: np.ndarray) -> np.ndarray:
            return np.ascontiguousarray((weights * by).reshape(-1, 4, HIDDEN).transpose(1, 0, 2))

        wx = by_gate(self.p[f"{side}x"] + self.p[f"{side}c"]).reshape(4 * CLASSES, HIDDEN)
        wh = by_gate(self.p[f"{side}h"]) / 2  # the states are twice as large
        z, part = np.zeros((4, n, HIDDEN), kind), np.zeros((4, n, HIDDEN), kind)
        h, c, th = (np.zeros((n, HIDDEN), kind) for _ in range(3))
        codes = np.ascontiguousarray(x.T)
        whole = (codes > 0).all(1)
        row, place = CLASSES * np.arange(4)[:, None], np.empty((4, n), np.int64)
        for t in range(length) if side == "f" else range(length - 1, -1, -1):
            np.add(row, codes[t], out=place)
            np.take(wx, place, axis=0, out=z, mode="clip")
            np.matmul(h, wh, out=part)
            z += part
            np.tanh(z, out=z)
            i, f, o, g = z
            z[:3] += 1
            c *= f
            i *= g
            c += i
            c *= 0.5
            np.tanh(c, out=th)
            np.multiply(o, th, out=h)
            if not whole[t]:
                real = (codes[t] > 0)[:, None]
                c *= real
                h *= real
            yield t, h

    def _states(self, x: np.ndarray, side: str) -> np.ndarray:
        """The hidden states of ``_lstm``. In memory rows are units and columns are windows."""
        out = np.empty((x.shape[1], HIDDEN, len(x)), self.p["out"].dtype)
        for t, h in self._steps(x, side):
            np.multiply(h.T, 0.5, out=out[t])
        return out.transpose(0, 2, 1)

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tag sequences (n, length) by the transitions, and the marginal chance of each tag in them.

        Only windows where a run of other tags could beat "outside" are searched, see ``_may_win``; and of those only the stretches
        covered by a run whose moves, each at its largest gain (into the run, within it, out of it), outweigh the leads of "outside" at its
        characters. Everywhere else "outside" is best whatever stands around, so a stretch is searched by itself, between two characters
        outside. Chances are those within the stretch; where the best tags are all "outside" they are not computed (1).
        """
        out = np.ascontiguousarray(self.p["out"].T) / 2
        scores = np.empty((x.shape[1], TAGS, len(x)), out.dtype)
        for t, h in self._steps(x, "f"):
            np.matmul(out[:, :HIDDEN], h.T, out=scores[t])
        more, bias = np.empty(scores.shape[1:], out.dtype), self.p["bias"][:, None]
        begin, inside = (np.empty((x.shape[1], len(x)), out.dtype) for _ in range(2))
        for t, h in self._steps(x, "b"):
            np.matmul(out[:, HIDDEN:], h.T, out=more)
            more += bias
            scores[t] += more
            for lead, first in ((begin, 1), (inside, 2)):
                np.max(scores[t, first::2], axis=0, out=lead[t])
                lead[t] -= scores[t, 0]
        tags, chance = np.zeros(x.shape, np.int64), np.ones(x.shape, scores.dtype)
        some = np.flatnonzero(self._may_win(begin, inside, x))
        if len(some):
            tags[some], chance[some] = self._search_stretches(scores[:, :, some], x[some])
        return tags, chance

    def _may_win(self, begin: np.ndarray, inside: np.ndarray, x: np.ndarray) -> np.ndarray:
        """In which windows a run of other tags could be worth more than "outside", at the largest gain of each kind of move and the largest
        lead (over "outside") that any beginning and any inside tag has at each character."""
        gain = np.where(ALLOWED, self.p["move"], -np.inf) - self.p["move"][0, 0]
        b, i = np.arange(1, TAGS, 2), np.arange(2, TAGS, 2)
        enter, again, goes_in, stays = (float(v.max()) for v in (gain[0, b], gain[1:][:, b], gain[b, i], gain[i, i]))
        first, last = (np.empty_like(begin) for _ in range(2))  # most that a run is worth up to a character with such a tag
        first[0], last[0] = begin[0] + max(enter, 0), inside[0]  # a window may begin within a run
        one, two = (np.empty_like(begin[0]) for _ in range(2))
        for t in range(1, len(begin)):
            np.maximum(first[t - 1], last[t - 1], out=one)
            one += again
            np.maximum(one, enter, out=one)
            np.add(one, begin[t], out=first[t])
            np.add(first[t - 1], goes_in, out=one)
            np.add(last[t - 1], stays, out=two)
            np.maximum(one, two, out=one)
            np.add(one, inside[t], out=last[t])
        length = (x > 0).sum(1)
        end = np.maximum(length - 1, 0), np.arange(len(x))  # and end within one
        most = np.maximum(first[end], last[end])
        first += float(gain[b, 0].max())
        last += float(gain[i, 0].max())
        np.maximum(first, last, out=first)
        return (length > 0) & (np.maximum(most, np.where(x.T > 0, first, -np.inf).max(0)) > -1e-3)  # sums are rounded

    def _search_stretches(self, scores: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gain = np.where(ALLOWED, self.p["move"], -np.inf) - self.p["move"][0, 0]
        enter, within, leave = float(gain[0, 1:].max()), float(gain[1:, 1:].max()), float(gain[1:, 0].max())
        worth = np.where(x.T > 0, within - scores[:, 0] + scores[:, 1:].max(1), -np.inf).astype(scores.dtype)
        # A run at the edge of the window has no move into it, or none out of it.
        worth[0] -= min(enter, 0)
        worth[np.maximum((x > 0).sum(1), 1) - 1, np.arange(len(x))] -= min(leave, 0)
        upto, run = np.empty_like(worth), np.zeros(len(x), worth.dtype)
        for t, step in enumerate(worth):
            upto[t] = run = np.maximum(run, 0) + step
        run = np.zeros(len(x), worth.dtype)
        for t in range(len(worth) - 1, -1, -1):
            upto[t] += np.maximum(run, 0)
            run = np.maximum(run, 0) + worth[t]
        tags, chance = np.zeros(x.shape, np.int64), np.ones(x.shape, scores.dtype)
        doubtful = np.pad((upto > within - enter - leave).T, ((0, 0), (1, 1))).astype(np.int8)
        row, start = np.nonzero(np.diff(doubtful) == 1)
        end = np.nonzero(np.diff(doubtful) == -1)[1]
        opened, closed = start > 0, end < x.shape[1]
        start, end = start - opened, end + closed
        order = np.argsort(end - start, kind="stable")
        for k in range(0, len(order), SEARCHED_TOGETHER):
            some = order[k : k + SEARCHED_TOGETHER]
            size = (end - start)[some]
            at = np.minimum(start[some, None] + np.arange(size.max()), x.shape[1] - 1)
            here = np.arange(size.max()) < size[:, None]
            rows = np.broadcast_to(row[some, None], at.shape)
            part = scores[at.T, :, rows.T]
            border = np.arange(len(some))
            part[0, border[opened[some]], 1:] = -1e4
            part[size[closed[some]] - 1, border[closed[some]], 1:] = -1e4
            won = np.flatnonzero(self._beats_outside(part, size))
            if not len(won):
                continue
            part, here, rows, at = np.ascontiguousarray(part[:, won]), here[won], rows[won], at[won]
            found, sure = self._search(part, np.where(here, x[rows, at], 0))
            inside = here & (found > 0)
            tags[rows[inside], at[inside]], chance[rows[inside], at[inside]] = found[inside], sure[inside]
        return tags, chance

    def _beats_outside(self, e: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether some tags of a stretch are worth more than "outside" throughout: the search's sums without the ways to them.
        ``size``: the stretches' lengths, ascending."""
        into = np.ascontiguousarray(np.where(ALLOWED, self.p["move"], -1e4).astype(e.dtype).T)[:, :, None]
        best = np.ascontiguousarray(e[0].T)
        outside, out, first = best[0].copy(), np.zeros(len(size), bool), 0
        for t in range(1, len(e) + 1):
            ended = int(np.searchsorted(size, t, "right")) - first
            if ended:
                out[first : first + ended] = best[:, :ended].max(0) > outside[:ended]
                first, best, outside = first + ended, best[:, ended:], outside[ended:]
            if first == len(size):
                break
            step = e[t, first:].T
            best = (best + into).max(1) + step
            outside = (outside + into[0, 0]) + step[0]
        return out

    def _search(self, e: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        move = np.where(ALLOWED, self.p["move"], -1e4).astype(e.dtype)
        length, n, _ = e.shape
        into = np.ascontiguousarray(move.T)
        best, back = e[0], np.zeros((length, n, TAGS), np.int8)
        for t in range(1, length):
            score = best[:, None, :] + into
            came = score.argmax(2)
            on = x[:, t] > 0
            back[t] = np.where(on[:, None], came, np.arange(TAGS))
            best = np.where(on[:, None], np.take_along_axis(score, came[:, :, None], 2)[:, :, 0] + e[t], best)
        tags = np.zeros((n, length), np.int64)
        tags[:, -1] = best.argmax(1)
        rows = np.arange(n)
        for t in range(length - 1, 0, -1):
            tags[:, t - 1] = back[t][rows, tags[:, t]]
        chance = np.ones(x.shape, e.dtype)
        some = np.flatnonzero(tags.any(1))
        if len(some):
            _, marginal, _ = self._forward_backward(np.ascontiguousarray(e[:, some]), x[some])
            chance[some] = marginal[np.arange(length)[None, :], np.arange(len(some))[:, None], tags[some]]
        return tags, chance
