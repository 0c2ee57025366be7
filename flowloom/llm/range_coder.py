"""An adaptive range coder for token ids: order-0 to order-2 predictions, mixed into one distribution per id.

Ids are coded in blocks that are reset and checked for themselves. Many blocks go side by side, one id of each a step, so that the
model and the coder are array operations over the blocks.

A step's distribution is w0 * P0 + w1 * P1 + w2 * P2. P0 are the frequencies of ids that a block is reset to (Prior, which a chunk
of blocks has in its head); P1 and P2 are on the id that came last after the same one and the same two ids. The weights are
adaptive: they follow how often each prediction held, in the block so far, when the contexts had held as often in a row as now.
Each part has its own interval, and an id that several parts predict takes the widest of its own, so that the decoder needs no
search; against one interval of the sum this costs about 0.02 bits an id.
"""

from __future__ import annotations

import zlib

import numpy as np

BLOCK = 2048
#: Blocks that go side by side.
LANES = 4096
_SLOTS1, _SLOTS2 = 128, 256
_STATES, _WEIGHT_BITS, _PRIOR_BITS = 16, 12, 16
_ALL = 1 << _WEIGHT_BITS
#: After how many ids of a block the weights are renewed, and then every 256.
_EARLY = (8, 24, 64, 128)
#: How often in a row a context has held (0: it is new, at most 3), after a miss (0 to 3) and a hit (4 to 7).
_HELD = np.array([1, 1, 1, 1, 1, 2, 3, 3], np.uint32) << np.uint32(16)
_ALL_BITS, _SHARE, _LEAST = _WEIGHT_BITS + _PRIOR_BITS, 0xFFFFFFFF, 1 << 32
_U16, _U48 = np.uint64(16), np.uint64(48)


class Prior:
    """Frequencies of ids, 65536 in all: begin and share by id, and the id by place. Without ids, each has the same."""

    def __init__(self, ids: np.ndarray | None = None):
        share = np.ones(1 << 16, np.int64)
        if ids is not None and len(ids):
            share = self._rounded(np.bincount(ids, minlength=1 << 16))
        self._set(share)

    def _set(self, share: np.ndarray) -> None:
        self.share, begin = share, np.cumsum(share) - share
        self.both = begin | share << 32
        self.id = np.repeat(np.arange(1 << 16), share)

    @staticmethod
    def _rounded(count: np.ndarray) -> np.ndarray:
        """Shares that are 1 at least where there is a count, and add up to 65536."""
        used = np.flatnonzero(count)
        share = np.maximum(1, (count[used] << _PRIOR_BITS) // count.sum())
        by_size = np.argsort(-share, kind="stable")
        over = int(share.sum()) - (1 << _PRIOR_BITS)
        if over < 0:
            share[by_size[0]] -= over
        for i in by_size.tolist():  # the largest ones make up for those that were rounded up
            if over <= 0:
                break
            less = min(over, int(share[i]) - 1, max(1, int(share[i]) // 8))
            share[i] -= less
            over -= less
        while over > 0:  # nearly all ids are there
            some = np.flatnonzero(share > 1)[:over]
            share[some] -= 1
            over -= len(some)
        out = np.zeros(1 << 16, np.int64)
        out[used] = share
        return out

    def pack(self) -> bytes:
        """The ids that have a share, as differences, and the shares less 1: 16 bits each, deflated."""
        used = np.flatnonzero(self.share)
        low, high = (self.share[used] - 1).astype("<u2").view(np.uint8).reshape(-1, 2).T
        return zlib.compress(np.diff(used, prepend=0).astype("<u2").tobytes() + low.tobytes() + high.tobytes(), 6)

    @classmethod
    def unpack(cls, data: bytes) -> Prior:
        raw = zlib.decompress(data)
        n = len(raw) // 4
        share = np.zeros(1 << 16, np.int64)
        low, high = (np.frombuffer(raw, np.uint8, n, 2 * n + i * n).astype(np.int64) for i in (0, 1))
        share[np.cumsum(np.frombuffer(raw, "<u2", n).astype(np.int64))] = (low | high << 8) + 1
        out = cls.__new__(cls)
        out._set(share)
        return out


class _Model:
    """guess1, guess2: by slot of an order-1 and an order-2 context, the last id after it, and above how often it held in a row."""

    def __init__(self, lanes: int, prior: Prior):
        self.prior = prior
        lane = np.arange(lanes)  # places are int64, which numpy looks up fastest
        self.lane1, self.lane2, self.lane_row = lane * _SLOTS1, lane * _SLOTS2, lane * _STATES
        self.guess1, self.guess2 = np.zeros(lanes * _SLOTS1, np.uint32), np.zeros(lanes * _SLOTS2, np.uint32)
        self.p1, self.h2 = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.met: list[np.ndarray] = []  # what held under which state since the weights were last renewed
        # under a state, how often order 2, else order 1, else neither held; at first as is usual
        held1, held2 = np.arange(_STATES) & 3, np.arange(_STATES) >> 2
        start = np.stack([4 * held2**2, 2 * held1, np.where((held1 + held2) > 0, 10, 60), 0 * held1], axis=1)
        self.count = np.tile(start + 1, (lanes, 1)).astype(np.int32)
        self.renew()

    def renew(self) -> None:
        if self.met:
            self.count += np.bincount(np.concatenate(self.met), minlength=self.count.size).astype(np.int32).reshape(self.count.shape)
            self.met.clear()
        c = self.count[:, :3]
        total = c.sum(axis=1, dtype=np.int32)
        w2, w1 = (1 + c[:, i] * (_ALL - 64) // total for i in (0, 1))
        #: w2 and w1 as they stand above the prior's bits, and w0
        self.w = w2.astype(np.int64) << 32 | w1.astype(np.int64) << 16 | (_ALL - w2 - w1)
        if (old := total > 512).any():
            self.count[old] = (self.count[old] + 1) >> 1

    def predict(self, n: int) -> None:
        """Of the first n lanes: the guesses and the weights."""
        self.at1 = self.lane1[:n] + (self.p1[:n] & (_SLOTS1 - 1))
        self.at2 = self.lane2[:n] + (self.h2[:n] & (_SLOTS2 - 1))
        got1, got2 = self.guess1.take(self.at1), self.guess2.take(self.at2)
        self.g1, self.g2 = got1 & np.uint32(0xFFFF), got2 & np.uint32(0xFFFF)
        self.c1, self.c2 = got1 >> np.uint32(16), got2 >> np.uint32(16)
        self.row = self.lane_row[:n] + (self.c1 + (self.c2 << np.uint32(2)))
        w = self.w.take(self.row)
        self.w0, self.w1, self.w2 = w & 0xFFFF, w & 0xFFFF0000, w >> 32 << 16
        self.w12 = self.w1 + self.w2

    def hits(self, x: np.ndarray) -> None:
        self.hit1, self.hit2 = x == self.g1, x == self.g2

    def interval(self, x: np.ndarray, use1: np.ndarray, use2: np.ndarray, both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and width of ids within the part of the mixture that is used: order 2, order 1, then the prior."""
        begin = np.where(use1, self.w2, self.w12 + self.w0 * (both & _SHARE))
        begin *= ~use2
        return begin, np.where(use2, self.w2, np.where(use1, self.w1, self.w0 * (both >> 32)))

    def update(self, n: int, x: np.ndarray, step: int) -> None:
        """After hits(x)."""
        self.guess1[self.at1] = x | _HELD.take(self.c1 + (self.hit1 << 2))
        self.guess2[self.at2] = x | _HELD.take(self.c2 + (self.hit2 << 2))
        symbol = np.where(self.hit2, 0, 2 - self.hit1)
        self.met.append(self.row * 4 + symbol)
        self.h2[:n] = self.p1[:n] * 7 + x
        self.p1[:n] = x
        if step + 1 in _EARLY or step % 256 == 255:
            self.renew()


def _encode(ids: np.ndarray, sizes: np.ndarray, prior: Prior) -> list[bytes]:
    """ids: a row per step, a column per lane; only the last lane may be shorter."""
    lanes = ids.shape[1]
    model = _Model(lanes, prior)
    low, rng = np.zeros(lanes, np.uint64), np.full(lanes, 1 << 48, np.int64)
    cap = 2 * len(ids) + 5
    out, ptr = np.zeros(lanes * cap, np.uint16), np.arange(lanes, dtype=np.int64) * cap
    for step in range(len(ids)):
        n = lanes if step < sizes[-1] else lanes - 1
        x = ids[step, :n].astype(np.int64)
        model.predict(n)
        model.hits(x)
        both = prior.both.take(x)
        least = model.w0 * (both >> 32)
        use2, use1 = model.hit2 & (model.w2 >= least), model.hit1 & (model.w1 >= least)
        begin, width = model.interval(x, use1, use2, both)
        r = rng[:n] >> _ALL_BITS
        add = (r * begin).view(np.uint64)
        r *= width
        rng[:n] = r
        low[:n] += add
        over = np.flatnonzero(low[:n] < add)
        if len(over):  # carry into the words before
            at = ptr[over]
            while len(at):
                at = at - 1
                out[at] += np.uint16(1)
                at = at[out[at] == 0]
        short = r < _LEAST
        put = np.flatnonzero(short)
        out[ptr[put]] = (low[:n] >> _U48)[put]
        ptr[:n] += short
        shift = short * 16
        low[:n] <<= shift.view(np.uint64)
        rng[:n] <<= shift
        few = np.flatnonzero(rng[:n] < _LEAST)
        while len(few):  # few lanes have another word
            out[ptr[few]] = low[few] >> _U48
            ptr[few] += 1
            low[few] <<= _U16
            rng[few] <<= 16
            few = few[rng[few] < _LEAST]
        model.update(n, x, step)
    for shift in (48, 32, 16, 0):
        out[ptr] = (low >> np.uint64(shift)) & np.uint64(0xFFFF)
        ptr += 1
    starts = np.arange(lanes) * cap + 1  # the first word is 0: the range begins below it
    return [out[a:b].astype("<u2").tobytes() for a, b in zip(starts.tolist(), ptr.tolist())]


def _decode(blocks: list[bytes], sizes: np.ndarray, prior: Prior) -> np.ndarray:
    lanes, steps = len(blocks), int(sizes.max(initial=0))
    model = _Model(lanes, prior)
    words = np.frombuffer(b"".join(blocks) + b"\0\0\0\0", "<u2").astype(np.int64)
    lens = np.array([len(b) // 2 for b in blocks], np.int64)
    ptr = np.cumsum(lens) - lens
    diff = words[ptr] << 32 | words[ptr + 1] << 16 | words[ptr + 2]
    ptr = ptr + 3
    rng = np.full(lanes, 1 << 48, np.int64)
    out = np.zeros((steps, lanes), np.uint16)
    for step in range(steps):
        n = lanes if step < sizes[-1] else lanes - 1
        model.predict(n)
        r = rng[:n] >> _ALL_BITS
        # quotients are exact enough in doubles: dividends are under 2 ** 48
        q = diff[:n] / r
        use2, use0 = q < model.w2, q >= model.w12
        rest = prior.id.take(((q - model.w12) / model.w0).astype(np.int64), mode="clip")
        x = np.where(use2, model.g2, np.where(use0, rest, model.g1))
        model.hits(x)
        begin, width = model.interval(x, ~use0, use2, prior.both.take(x))
        d = diff[:n] - r * begin
        r *= width
        diff[:n] = d
        rng[:n] = r
        short = r < _LEAST
        got = np.flatnonzero(short)
        shift = short * 16
        diff[:n] <<= shift
        rng[:n] <<= shift
        diff[got] |= words.take(ptr[got], mode="clip")
        ptr[:n] += short
        few = np.flatnonzero(rng[:n] < _LEAST)
        while len(few):
            diff[few] = diff[few] << 16 | words.take(ptr[few], mode="clip")
            ptr[few] += 1
            rng[few] <<= 16
            few = few[rng[few] < _LEAST]
        out[step, :n] = x
        model.update(n, x, step)
    return out


def _sizes(n: int, block: int) -> np.ndarray:
    return np.minimum(block, n - np.arange(0, n, block))


def _turned(a: np.ndarray, side: int = 64) -> np.ndarray:
    """a.T, copied in squares that stay in the cache."""
    out = np.empty(a.shape[::-1], a.dtype)
    for i in range(0, a.shape[0], side):
        for j in range(0, a.shape[1], side):
            out[j : j + side, i : i + side] = a[i : i + side, j : j + side].T
    return out


def encode_ids(ids: np.ndarray, block: int = BLOCK, prior: Prior | None = None) -> list[bytes]:
    """Blocks of ids (each under 65536, and with a share in the prior), in order; each is `block` ids long but the last."""
    if len(ids) and int(ids.max()) > 0xFFFF:
        raise ValueError("ids from 65536 on are not supported")
    prior = prior or Prior()
    out: list[bytes] = []
    for a in range(0, len(ids), block * LANES):
        part = ids[a : a + block * LANES]
        sizes = _sizes(len(part), block)
        width = int(sizes[0])
        full = np.zeros(len(sizes) * width, np.uint16)
        full[: len(part)] = part
        out += _encode(_turned(full.reshape(len(sizes), width)), sizes, prior)
    return out


def decode_ids(blocks: list[bytes], n: int, block: int = BLOCK, prior: Prior | None = None) -> np.ndarray:
    """The n ids of the blocks."""
    prior = prior or Prior()
    sizes, out = _sizes(n, block), []
    for a in range(0, len(blocks), LANES):
        part = sizes[a : a + LANES]
        out.append(_turned(_decode(blocks[a : a + LANES], part, prior)).ravel()[: int(part.sum())])
    return np.concatenate(out) if out else np.zeros(0, np.uint16)
