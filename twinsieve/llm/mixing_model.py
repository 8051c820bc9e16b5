"""Context mixing of bit predictors, in numpy (the model behind operator 10).

A byte is coded as eight bits, most significant first. For every order 1 to ORDERS - that
is, for the last 1 to 5 bytes before it - a hashed slot of (context, bits so far) holds how
often a 0 and a 1 followed in the corpus. Their log odds are the inputs of a mixer: a
logistic model whose weights are picked by a gate (the longest context that is known,
and how well) and by the place of the bit. A last table refines the mixed probability,
by its own value and the bits so far.

The weights are learnt online, slice after slice of the corpus, by Newton steps: a slice
adds its curvature to a fading memory of earlier ones and moves the weights by its gradient
on that scale. The first steps start far off, where a confident model hardly bends: they
are damped by a share of the greatest curvature there can be. A slice's sums are over all
its strings, in whatever parts they are taken.

While a text is coded, the model goes on refining: the mixed log odds are used as they are
and scaled by SCALES, and each of these predictors counts by how well it has foretold
the text so far. What all that costs is known without walking through the text: the
chances of the whole text under each predictor, averaged.

All contexts lie within the five bytes before, so the cost of a byte under one predictor is
a function of the six bytes that end with it. Costs of strings seen before are kept,
MEMO_STRINGS at most.
"""

from dataclasses import dataclass, field

import numpy as np

from twinsieve.llm.textbatch import Texts, seeded

ORDERS = 5
SLOTS_LOG2 = 20
SLOTS = 1 << SLOTS_LOG2
GATES = 3 * ORDERS + 1
CURVE = 33  # steps of the refining table over log odds -8 to 8
PRIOR = 20.0  # weight of the mixer's own opinion there
SCALES = (1.0, 0.75, 1.3)  # of log odds; the first with the last table, the others without
PRIOR_PRECISION = 5.0  # of a weight, besides what slices say
REMEMBERED = 0.3  # share of the curvature that the next slice still counts
DAMPING, DAMPING_LEFT = 0.1, 0.25  # share of the greatest curvature; what is left of it in the next slice
INPUTS = ORDERS + 1
_U = np.uint64
_LEAST = 2.0**-14
MEMO_STRINGS = 3_000_000


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def byte_strings(texts: Texts) -> np.ndarray:
    """For each byte of each text, and its end (a line's end byte becomes 0), the six
    bytes that end there as one number; zeros stand before the start of a text."""
    raw = texts.raw.astype(np.uint64)
    raw[texts.end] = 0
    out = raw.copy()
    start = np.zeros(len(raw), np.int64)
    start[texts.begin] = texts.begin
    into = np.arange(len(raw)) - np.maximum.accumulate(start)
    for i in range(1, ORDERS + 1):
        back = np.zeros(len(raw), np.uint64)
        back[i:] = raw[:-i] if i else raw
        back[into < i] = 0
        out |= back << _U(8 * i)
    return out


def slots_of(strings: np.ndarray, order: int, node: np.ndarray) -> np.ndarray:
    context = (strings >> _U(8)) & _U((1 << (8 * order)) - 1)
    mixed = seeded(context * _U(256) + node.astype(np.uint64), order)
    return (mixed >> _U(64 - SLOTS_LOG2)).astype(np.int64)


def bits_of(strings: np.ndarray):
    """(place, bits so far with a leading 1, bit) of the last byte, for the eight bits."""
    byte = (strings & _U(255)).astype(np.int64)
    for j in range(8):
        yield j, (1 << j) | (byte >> (8 - j)), (byte >> (7 - j)) & 1


def add_counts(counts: np.ndarray, strings: np.ndarray, times: np.ndarray) -> None:
    """Add what follows each context to counts[order - 1, bit, slot], of the type of `times`."""
    for order in range(1, ORDERS + 1):
        for _, node, bit in bits_of(strings):
            at = bit * SLOTS + slots_of(strings, order, node)
            np.add.at(counts[order - 1].reshape(-1), at, times)


@dataclass
class Mixer:
    counts: np.ndarray  # (ORDERS, 2, SLOTS) float32
    weights: np.ndarray  # (GATES, 8, INPUTS)
    curve: np.ndarray  # (2, CURVE, 256)
    precision: np.ndarray  # (GATES, 8, INPUTS, INPUTS)
    # Sorted strings with their costs, each level less than half of the one before.
    memo: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    @classmethod
    def fresh(cls, counts: np.ndarray) -> "Mixer":
        weights = np.full((GATES, 8, INPUTS), 0.35)
        weights[:, :, -1] = 0
        return cls(counts, weights, np.zeros((2, CURVE, 256)), np.zeros((GATES, 8, INPUTS, INPUTS)))

    def inputs(self, strings: np.ndarray, node: np.ndarray, bit: np.ndarray, leave_out: int):
        """Log odds by order, and the gate. `leave_out` 1 takes the case itself out of
        the counts, for learning from the corpus that was counted."""
        odds = np.empty((INPUTS, len(strings)))
        gate = np.zeros(len(strings), np.int64)
        for order in range(1, ORDERS + 1):
            at = slots_of(strings, order, node)
            zero, one = self.counts[order - 1][:, at].astype(np.float64)
            if leave_out:
                zero = np.maximum(zero - (1 - bit), 0)
                one = np.maximum(one - bit, 0)
            n = zero + one
            odds[order - 1] = np.log((one + 0.4) / (zero + 0.4))
            level = (n > 0) * 1 + (n > 2) + (n > 8)
            gate = np.where(n > 0, 3 * (order - 1) + level, gate)
        odds[ORDERS] = 0.3
        return odds, gate

    def mixed(self, odds: np.ndarray, gate: np.ndarray, j: int) -> np.ndarray:
        return np.clip((self.weights[gate, j].T * odds).sum(0), -12, 12)

    @staticmethod
    def step_of(z: np.ndarray) -> np.ndarray:
        return np.clip(np.rint(2 * z) + CURVE // 2, 0, CURVE - 1).astype(np.int64)

    def add_slopes(self, sums: np.ndarray, strings: np.ndarray, times: np.ndarray, number: int) -> None:
        """Add gradient and curvature of the weights, at the slice of this number, to sums
        (GATES, 8, INPUTS, INPUTS + 1), the gradient in the last column."""
        damping = DAMPING * DAMPING_LEFT**number
        for j, node, bit in bits_of(strings):
            odds, gate = self.inputs(strings, node, bit, 1)
            p = sigmoid(self.mixed(odds, gate, j))
            error = (bit - p) * times
            bend = ((1 - damping) * p * (1 - p) + damping / 4) * times
            for k in range(INPUTS):
                sums[:, j, k, INPUTS] += np.bincount(gate, error * odds[k], GATES)
                for i in range(k + 1):
                    part = np.bincount(gate, bend * odds[i] * odds[k], GATES)
                    sums[:, j, k, i] += part
                    if i < k:
                        sums[:, j, i, k] += part

    def step(self, sums: np.ndarray) -> None:
        """Move the weights by what one slice says."""
        self.precision = REMEMBERED * self.precision + sums[..., :INPUTS]
        scale = self.precision + PRIOR_PRECISION * np.eye(INPUTS)
        self.weights = self.weights + np.linalg.solve(scale, sums[..., INPUTS:])[..., 0]

    def add_outcomes(self, curve: np.ndarray, strings: np.ndarray, times: np.ndarray) -> None:
        """Count outcomes for the last table."""
        for j, node, bit in bits_of(strings):
            odds, gate = self.inputs(strings, node, bit, 1)
            step = self.step_of(self.mixed(odds, gate, j))
            np.add.at(curve, (bit, step, node), times)

    def costs(self, strings: np.ndarray) -> np.ndarray:
        """Bits that the last byte of each string takes, by predictor and string."""
        total = np.zeros((len(SCALES), len(strings)))
        for j, node, bit in bits_of(strings):
            odds, gate = self.inputs(strings, node, bit, 0)
            z = self.mixed(odds, gate, j)
            step = self.step_of(z)
            zero, one = self.curve[0][step, node], self.curve[1][step, node]
            for k, scale in enumerate(SCALES):
                p = sigmoid(scale * z)
                if k == 0:
                    p = (p + (one + PRIOR * p) / (zero + one + PRIOR)) / 2
                p = np.clip(p, _LEAST, 1 - _LEAST)
                total[k] -= np.log2(np.where(bit == 1, p, 1 - p))
        return total

    def known_costs(self, strings: np.ndarray) -> np.ndarray:
        """As `costs`, for sorted distinct strings, by way of the memo."""
        out, open_ = np.zeros((len(SCALES), len(strings))), np.arange(len(strings))
        for items, costs in self.memo:
            at = np.minimum(np.searchsorted(items, strings[open_]), len(items) - 1)
            found = items[at] == strings[open_]
            out[:, open_[found]] = costs[:, at[found]]
            open_ = open_[~found]
        if not len(open_):
            return out
        new = strings[open_]
        out[:, open_] = np.concatenate([self.costs(new[a : a + 65536]) for a in range(0, len(new), 65536)], 1)
        if sum(len(items) for items, _ in self.memo) + len(new) > MEMO_STRINGS:
            self.memo.clear()
        self.memo.append((new, out[:, open_]))
        while len(self.memo) > 1 and 2 * len(self.memo[-1][0]) > len(self.memo[-2][0]):
            (items, costs), (more, more_costs) = self.memo.pop(), self.memo.pop()
            items, costs = np.concatenate((items, more)), np.concatenate((costs, more_costs), 1)
            order = np.argsort(items)
            self.memo.append((items[order], costs[:, order]))
        return out

    @staticmethod
    def blended(bits: np.ndarray) -> np.ndarray:
        """Bits of whole texts, from those under each predictor."""
        least = bits.min(0)
        return least - np.log2((2.0 ** (least - bits)).mean(0))

    def text_bits(self, texts: Texts) -> np.ndarray:
        """Bits for each whole text and its end."""
        own, place = np.unique(byte_strings(texts), return_inverse=True)
        bits = np.empty((len(SCALES), len(texts.end)))
        for k, costs in enumerate(self.known_costs(own)):
            total = np.concatenate(([0.0], np.cumsum(costs[place])))
            bits[k] = total[texts.end + 1] - total[texts.begin]
        return self.blended(bits)
