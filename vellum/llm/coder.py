"""An adaptive context-mixing range coder for token ids below 65,536.

A block's ids are laid out in lanes, contiguous stretches that are coded in step. All lanes share one model, which
starts empty in every block, and each has its own range coder. An id's probability is the sum of three shares:

    a2 * its share of what followed the last two ids + a1 * its share of what followed the last id + a0 * its frequency

Orders 2 and 1 know the ``TWO_MOST`` and ``ONE_MOST`` ids seen most often after a context; order 0 knows the block's
ids so far, with an escape for others. Order 2 has one pair of ids a slot, which is compared, so contexts never mix.
The ids that either order lists come first in the range, each once with its summed width; all others follow by their
frequency, the listed ones left out. The weights a2, a1, a0 belong to a pair of confidences (how much of what followed
a context its list covers) and are learned by expectation-maximisation: each id that was coded counts for the three
orders in proportion to their parts of its width.

Counts of all lanes are folded in after the steps ``FIRST`` and every ``REFRESH``; the mix of every context is then
tabulated, so a step is a look-up. Everything is whole numbers; encoder and decoder make the same updates. The range
coder works on 48 bits with 16-bit output; carries are added when a block is finished.

Defined results. No ids: a block of none. Ids of 65,536 or more, or negative: ValueError. A block ends with a checksum
of its ids; one that differs on reading raises ValueError.
"""

from __future__ import annotations

import zlib

import numpy as np

LANES, LANE_TOKENS = 8192, 256
ESCAPE = 48
FIRST, REFRESH = (1, 4, 16, 64, 128), 256
TWO_MOST, ONE_MOST = 4, 8
LISTED = TWO_MOST + ONE_MOST
#: Shares within a list are fractions of 1 << SHARE, weights of 1 << 16, widths of 1 << 24.
SHARE = 12
LEVELS = 6
#: What the listed orders can have of 1 << 16 at most.
MOST_LISTED = 65000
#: Rows of the tables are padded to so many places of 16 bits; NONE fills the places that list nothing.
PLACES = 16
NONE = (1 << 16) - 1
ESCAPED = 1 << 50
#: So many known steps are sorted together, to bound the memory that takes; their ids are placed so many at once, which
#: the processor's cache holds.
AHEAD, AT_ONCE = 64, 1 << 13
#: The range coder's digits and the least range before one is put out.
LOW = (1 << 32) - 1
FLOOR = 1 << 32


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of sorted codes and their counts."""
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.diff(first, append=len(codes))


class Order:
    """How often ids followed each of 65,536 contexts, as sorted codes context << 16 | id and their counts."""

    def __init__(self, most: int):
        self.most = most
        self.codes, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def add(self, codes: np.ndarray) -> None:
        if not len(codes):
            return
        new, n = counted(np.sort(codes))
        both = np.sort(np.concatenate([self.codes.astype(np.int64) << 31 | self.counts, new.astype(np.int64) << 31 | n]))
        code = both >> 31
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        self.codes, self.counts = code[first].astype(np.uint32), np.add.reduceat(both & (1 << 31) - 1, first)

    def listed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The contexts, the ids most often seen after each (-1: none; a column a context), their shares, and a level of confidence from 1."""
        if not len(self.codes):
            return np.zeros(0, np.int64), np.zeros((self.most, 0), np.int32), np.zeros((self.most, 0), np.int32), np.zeros(0, np.int32)
        own, size = counted(self.codes >> np.uint32(16))
        start = np.cumsum(size) - size
        rare = (1 << 24) - 1 - np.minimum(self.counts, (1 << 24) - 1)
        order = np.sort((self.codes >> np.uint32(16)).astype(np.int64) << 40 | rare << 16 | (self.codes & np.uint32(0xFFFF)))
        best, seen = np.full((self.most, len(own)), -1, np.int32), np.zeros((self.most, len(own)), np.int64)
        for k in range(self.most):
            with_k = np.flatnonzero(size > k)
            found = order.take(start[with_k] + k)
            best[k, with_k], seen[k, with_k] = found & 0xFFFF, (1 << 24) - 1 - (found >> 16 & (1 << 24) - 1)
        sums = seen.sum(0)
        # how far the list can be trusted: its share of all that followed, less what a short history leaves open
        open_ended = np.add.reduceat(np.minimum(self.counts, (1 << 24) - 1), start) + np.minimum(size, self.most) + 1
        level = 1 + np.minimum(sums * (LEVELS - 1) // open_ended, LEVELS - 2)
        return own.astype(np.int64), best, floor_div(seen << SHARE, sums).astype(np.int32), level.astype(np.int32)


def floor_div(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a // b of whole numbers from 0 to below 2^53: the quotient in double precision never rounds up to the next one."""
    return (a / b).astype(np.int64)


def slot_of(pair: np.ndarray) -> np.ndarray:
    """The slot of a pair of ids (before << 16 | last, unsigned 32-bit)."""
    return (pair >> np.uint32(16)) * np.uint32(40503) + (pair & np.uint32(0xFFFF)) * np.uint32(2654435761) >> np.uint32(9) & np.uint32(0xFFFF)


def count_true(found: np.ndarray) -> np.ndarray:
    """How many of each row's PLACES flags are set: the bytes of whole words are added up."""
    words = found.view(np.uint64)
    return (((words[:, 0] + words[:, 1]) * np.uint64(0x0101010101010101)) >> np.uint64(56)).astype(np.int64)


def place_true(found: np.ndarray) -> np.ndarray:
    """The place of the one flag that is set in each row of PLACES, from 1; 0 if none is: bytes times their places."""
    words = found.view(np.uint64)
    return (words[:, 0] * np.uint64(0x0102030405060708) + words[:, 1] * np.uint64(0x090A0B0C0D0E0F10) >> np.uint64(56)).astype(np.int64)


def table(columns: np.ndarray, filler: int) -> np.ndarray:
    """Columns as rows of PLACES values."""
    rows = np.full((columns.shape[1], PLACES), filler, np.uint16)
    rows[:, : len(columns)] = columns.T
    return rows


class Model:
    """The shared predictions; ids of a step come as one array, a lane each.

    The tables have a row for each context that was seen, slots of order 2 and ids of order 1 where order 2 knows nothing;
    row 0 is for all others.
    """

    def __init__(self, lanes: int):
        self.one, self.two = Order(ONE_MOST), Order(TWO_MOST)
        self.last, self.pair = np.zeros(lanes, np.int64), np.zeros(lanes, np.uint32)
        self.counts = np.zeros(1 << 16, np.int64)
        self.came = np.tile(np.array([256, 256, 512], np.int64), (LEVELS * LEVELS, 1))
        # a free slot holds a pair of another slot
        every = np.arange(1 << 16, dtype=np.uint32)
        self.held = (every == slot_of(np.zeros(1, np.uint32))).astype(np.uint32)
        self.step = 0
        self.fresh: list[tuple[np.ndarray, np.ndarray]] = []
        #: The places in the tables that gave ids, or the complements of their rows, and how often each did.
        self.coded: list[tuple[np.ndarray, np.ndarray]] = []
        #: The rows of slots, then of contexts of order 1.
        self.rows = np.zeros(2 << 16, np.int32)
        self.frequencies()
        self.tabulate()

    @property
    def owner(self) -> np.ndarray:
        """The pair of each slot, -1 if it is free."""
        return np.where(slot_of(self.held) == np.arange(1 << 16), self.held.astype(np.int64), -1)

    @property
    def cell(self) -> np.ndarray:
        """The pair of confidences of each slot, then of each context of order 1."""
        return self.cells.take(self.rows)

    def frequencies(self) -> None:
        """Order 0: frequencies that sum to 65,536, each id's start, and the id of each place (65,536: escape)."""
        seen = np.flatnonzero(self.counts)
        self.freq, self.start = np.zeros((1 << 16) + 1, np.int32), np.zeros((1 << 16) + 1, np.int32)
        if not len(seen):
            self.places = np.full(1 << 16, 1 << 16, np.int32)
            self.freq[-1] = 1 << 16
            self.stretch = self.start.astype(np.int64) << 17 | self.freq
            return
        # with very many different ids the rarest go without and are escaped
        if len(seen) > 1 << 15:
            seen = np.sort(seen[np.argsort(-self.counts[seen], kind="stable")[: 1 << 15]])
        n = self.counts[seen]
        f = 1 + n * ((1 << 16) - ESCAPE - len(seen)) // n.sum()
        f[n.argmax()] += (1 << 16) - ESCAPE - f.sum()
        self.freq[seen] = f
        ends = np.cumsum(f)
        self.start[seen] = ends - f
        self.places = np.concatenate([np.repeat(seen, f), np.full(ESCAPE, 1 << 16)]).astype(np.int32)
        self.start[-1], self.freq[-1] = ends[-1], ESCAPE
        self.stretch = self.start.astype(np.int64) << 17 | self.freq

    def weigh(self) -> None:
        """Counts the orders' parts of what was coded since the last time for its confidences."""
        coded, often = (np.concatenate(x) for x in zip(*self.coded, strict=True))
        missed = coded < 0
        times = np.bincount(coded[~missed], often[~missed], self.ids.size).astype(np.int64)
        hit = np.flatnonzero(times)
        times, cells = times[hit], self.cells.take(hit // PLACES)
        some = self.ends.ravel().take(hit + 1) - self.ends.ravel().take(hit)
        parts = [floor_div(p[hit % PLACES, hit // PLACES].astype(np.int64) << 8, some) for p in (self.p2, self.p1)]
        sums = [np.bincount(cells, times * w, len(self.came)).astype(np.int64) for w in (*parts, 256 - parts[0] - parts[1])]  # below 2^53: exact
        sums[2] += 256 * np.bincount(self.cells, np.bincount(~coded[missed], often[missed], len(self.cells)), len(self.came)).astype(np.int64)
        self.came += np.stack(sums, 1)

    def refresh(self) -> None:
        """Learns from all that was coded since the last time, and tabulates the mix of every context."""
        if not self.fresh:
            return
        self.weigh()
        pair, ids = (np.concatenate(x) for x in zip(*self.fresh, strict=True))
        self.fresh.clear()
        self.coded.clear()
        self.counts += np.bincount(ids, minlength=1 << 16)
        self.frequencies()
        ids = ids.astype(np.uint32)
        self.one.add(pair << np.uint32(16) | ids)
        # free slots go to the most frequent pairs, for good
        often = np.flatnonzero(self.one.counts > 1)
        wish = self.one.codes[often]
        slots = slot_of(wish)
        free = np.flatnonzero(self.owner[slots] < 0)
        free = free[np.argsort(self.one.counts[often[free]], kind="stable")]
        self.held[slots[free]] = wish[free]  # of equal slots the last one stays
        slots = slot_of(pair)
        known = np.flatnonzero(self.held.take(slots) == pair)
        self.two.add(slots.take(known) << np.uint32(16) | ids.take(known))
        self.tabulate()

    def tabulate(self) -> None:
        own1, ids1, share1, level1 = self.one.listed()
        own2, ids2, share2, level2 = self.two.listed()
        n1, n2 = len(own1), len(own2)
        weights = self.came[:, :2] * MOST_LISTED // self.came.sum(1, keepdims=True)
        weights[:LEVELS, 0] = 0  # no list
        weights[::LEVELS, 1] = 0
        place = np.zeros(1 << 16, np.int64)
        place[own1] = np.arange(n1)
        b_row = np.concatenate([place[self.held[own2] & np.uint32(0xFFFF)], np.arange(n1)])  # an owner's last id has been a context
        # a column a row of the tables; the first is that of unknown contexts
        ids, share = np.full((LISTED, 1 + n2 + n1), -1, np.int32), np.zeros((LISTED, 1 + n2 + n1), np.int32)
        ids[:TWO_MOST, 1 : n2 + 1], share[:TWO_MOST, 1 : n2 + 1] = ids2, share2
        ids[TWO_MOST:, 1:], share[TWO_MOST:, 1:] = ids1.take(b_row, 1), share1.take(b_row, 1)
        cells = np.zeros(1 + n2 + n1, np.int32)
        cells[1:] = level1[b_row]
        cells[1 : n2 + 1] += level2 * LEVELS
        # order 1's shares of what order 2 lists too
        both = np.zeros((TWO_MOST, n2), np.int32)
        b_ids, b_share = ids[TWO_MOST:, 1 : n2 + 1], share[TWO_MOST:, 1 : n2 + 1]
        for k in range(TWO_MOST):
            same = (b_ids == ids2[k]) & (b_ids >= 0)
            both[k] = (same * b_share).sum(0, dtype=np.int32)
            b_ids[same] = -1
            b_share[same] = 0
        a2, a1 = weights.astype(np.int32).take(cells, 0).T
        p2, p1 = np.zeros_like(share), a1 * share >> SHARE - 8
        p2[:TWO_MOST] = a2 * share[:TWO_MOST] >> SHARE - 8
        p1[:TWO_MOST] = 0
        p1[:TWO_MOST, 1 : n2 + 1] = a1[1 : n2 + 1] * both >> SHARE - 8
        listed = ids >= 0
        f = self.freq.take(np.maximum(ids, 0)) * listed
        plain = ((65536 - a2 - a1).astype(np.uint32) * f.astype(np.uint32) >> np.uint32(8)).astype(np.int32)
        width = np.maximum(p2 + p1 + plain, 1) * listed
        # order 0's stretches of the listed ids, sorted: where they start, where they would with those before left out, and how
        # much lies before, in the end before all others
        stretch = np.where(f > 0, self.stretch.take(np.maximum(ids, 0)), NONE << 17)
        stretch = np.sort(np.ascontiguousarray(stretch.T), 1).T
        first, f = (stretch >> 17).astype(np.int32), (stretch & (1 << 17) - 1).astype(np.int32)
        before, ends = np.zeros((LISTED + 1, 1 + n2 + n1), np.int32), np.zeros((PLACES, 1 + n2 + n1), np.int32)
        np.cumsum(f, 0, out=before[1:])
        np.cumsum(width, 0, out=ends[1 : LISTED + 1])
        ends[LISTED + 1 :] = ends[LISTED]
        self.ids, self.first = table(np.where(listed, ids, NONE), NONE), table(first, NONE)
        self.shut = table(np.where(first < NONE, first - before[:-1], NONE), NONE)
        self.before = table(before, 0)
        #: Where the listed ids start and, in the next place, end; ends >> 8 for a first look; base << 17 | rest of what they leave.
        self.ends = np.ascontiguousarray(ends.T)
        self.near = table(ends[1 : LISTED + 1] >> 8, NONE)
        self.left = ends[-1].astype(np.int64) << 17 | (1 << 16) - before[-1]
        self.p2, self.p1, self.cells = p2, p1, cells
        self.rows[own2], self.rows[own1 + (1 << 16)] = np.arange(1, n2 + 1), np.arange(n2 + 1, n2 + n1 + 1)

    def rows_of(self, pair: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The rows of contexts."""
        slots = slot_of(pair.astype(np.uint32, copy=False)).astype(np.int64)
        return self.rows.take(np.where(self.held.take(slots) == pair, slots, last + (1 << 16))).astype(np.int64)

    def expect(self) -> None:
        """The row of each lane's context."""
        self.row = self.rows_of(self.pair, self.last)

    def learn(self, ids: np.ndarray, coded: np.ndarray) -> None:
        """coded: the place in the tables that gave an id, or the complement of its row where it was not listed."""
        self.coded.append((coded, np.ones(len(coded), np.int32)))
        self.fresh.append((self.pair, ids))
        self.pair = (self.last << 16 | ids).astype(np.uint32)
        self.last = ids
        self.step += 1
        if self.step in FIRST or not self.step % REFRESH:
            self.refresh()

    def unlisted(self, left: np.ndarray, at: np.ndarray, freq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and width of order 0's stretch of freq from at on, of what the listed ids leave."""
        base, rest = left >> 17, (left & (1 << 17) - 1).astype(np.float64)
        wide = ((1 << 24) - base).astype(np.float64)
        lo = (at * wide / rest).astype(np.int64)  # as floor_div()
        return base + lo, ((at + freq) * wide / rest).astype(np.int64) - lo

    def steps_left(self) -> int:
        """The steps before the tables change."""
        return next((k for k in FIRST if k > self.step), (self.step // REFRESH + 1) * REFRESH) - self.step

    def ahead(self, steps: np.ndarray) -> np.ndarray:
        """place() and learn() for steps_left() steps at most (a row each), which are known: ESCAPED, start << 25 | width of each id.

        Equal ids after equal contexts are placed once, in the order of the tables' rows.
        """
        last = np.concatenate([self.last[None], steps[:-1]])
        pair = np.concatenate([self.pair[None].astype(np.uint32), (last[:-1] << 16 | last[1:]).astype(np.uint32)])
        key = np.sort(self.rows_of(pair.ravel(), last.ravel()) << 37 | steps.ravel() << 21 | np.arange(steps.size))
        distinct, often = counted(key >> 21)
        placed, coded = np.empty(len(distinct), np.int64), np.empty(len(distinct), np.int64)
        for k in range(0, len(distinct), AT_ONCE):
            some = distinct[k : k + AT_ONCE]
            start, width, coded[k : k + AT_ONCE], escaped = self.find(some >> 16, some & NONE)
            start[escaped] |= ESCAPED >> 25
            placed[k : k + AT_ONCE] = start << 25 | width
        found = np.empty(steps.size, np.int64)
        found[key & (1 << 21) - 1] = np.repeat(placed, often)
        self.coded.append((coded, often))
        self.fresh.append((pair.ravel(), steps.ravel()))
        self.pair, self.last = (last[-1] << 16 | steps[-1]).astype(np.uint32), steps[-1]
        self.step += len(steps)
        if self.step in FIRST or not self.step % REFRESH:
            self.refresh()
        return found.reshape(steps.shape)

    def place(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start and width of ids, their places for learn(), and the lanes whose id follows an escape."""
        self.expect()
        return self.find(self.row, ids)

    def find(self, rows: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """place() of ids in contexts of given rows."""
        found = self.ids.take(rows, 0) == ids.astype(np.uint16)[:, None]
        if (ids == NONE).any():  # what fills a row looks like this id, but has no width
            found &= np.diff(self.ends.take(rows, 0), append=0) > 0
        places = place_true(found)  # a row lists an id once
        lane = np.flatnonzero(places)
        hit = rows.take(lane) * PLACES + places.take(lane) - 1
        begin = self.ends.ravel().take(hit)
        start, width, coded = np.empty(len(ids), np.int64), np.empty(len(ids), np.int64), ~rows
        coded[lane] = hit
        width[lane], start[lane] = self.ends.ravel().take(hit + 1) - begin, begin
        miss = np.flatnonzero(coded < 0)
        row, sym = rows.take(miss), ids.take(miss)
        stretch = self.stretch.take(sym)
        unseen = np.flatnonzero(stretch & (1 << 17) - 1 == 0)
        stretch[unseen] = self.stretch[-1]
        at = stretch >> 17
        before = self.before.ravel().take(row * PLACES + count_true(self.first.take(row, 0) < at.astype(np.uint16)[:, None]))
        start[miss], width[miss] = self.unlisted(self.left.take(row), at - before, stretch & (1 << 17) - 1)
        return start, width, coded, miss[unseen]

    def symbols(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """place() the other way: ids (65,536: escape), start, width and places from the slots of 1 << 24 that were coded."""
        start, width = np.empty(len(slot), np.int64), np.empty(len(slot), np.int64)
        ids, coded = np.empty(len(slot), np.int64), ~self.row
        left = self.left.take(self.row)
        listed = slot < left >> 17
        lane, miss = np.flatnonzero(listed), np.flatnonzero(~listed)
        row, own = self.row.take(lane), slot.take(lane)
        hit = row * PLACES + count_true(self.near.take(row, 0) < (own >> 8).astype(np.uint16)[:, None])
        end = self.ends.ravel().take(hit + 1)
        late = np.flatnonzero(end <= own)
        while len(late):  # ends that differ in the last 8 bits only
            hit[late] += 1
            end[late] = again = self.ends.ravel().take(hit.take(late) + 1)
            late = late[again <= own.take(late)]
        begin = self.ends.ravel().take(hit)
        coded[lane], ids[lane] = hit, self.ids.ravel().take(hit)
        width[lane], start[lane] = end - begin, begin
        row, left = self.row.take(miss), left.take(miss)
        base, rest = left >> 17, (left & (1 << 17) - 1).astype(np.float64)
        at = (((slot.take(miss) - base + 1) * rest - 1) / ((1 << 24) - base)).astype(np.int64)  # as floor_div()
        before = self.before.ravel().take(row * PLACES + count_true(self.shut.take(row, 0) <= np.minimum(at, NONE - 1).astype(np.uint16)[:, None]))
        sym = self.places.take(at + before)
        ids[miss] = sym
        stretch = self.stretch.take(sym)
        start[miss], width[miss] = self.unlisted(left, (stretch >> 17) - before, stretch & (1 << 17) - 1)
        return ids, start, width, coded


def encode(ids: np.ndarray) -> bytes:
    """ids (below 65,536) as one independent block."""
    n = len(ids)
    if n and not 0 <= int(ids.min()) <= int(ids.max()) < 1 << 16:
        raise ValueError("ids must be from 0 to below 65536")
    lanes = max(1, min(LANES, n // LANE_TOKENS))
    steps = -(-n // lanes)
    grid = np.zeros(lanes * steps, np.int64)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model = Model(lanes)
    low, rng = np.zeros(lanes, np.int64), np.full(lanes, 1 << 48)
    at_out: list[np.ndarray] = []
    words: list[np.ndarray] = []

    def shift(at: np.ndarray) -> None:
        """The lanes at put out 16 bits, and a carry if there is one."""
        while len(at):
            lo = low.take(at)
            at_out.append(at.astype(np.uint16))
            words.append((lo >> 32).astype(np.uint32))
            low[at] = (lo & LOW) << 16
            wide = rng.take(at) << 16
            rng[at] = wide
            at = at[wide < FLOOR]

    while model.step < steps:
        part = grid[model.step : model.step + min(AHEAD, model.steps_left())]
        for row, placed in zip(part, model.ahead(part), strict=True):
            r = rng >> 24
            low += (placed >> 25 & (1 << 24) - 1) * r
            rng = r * (placed & (1 << 25) - 1)
            shift(np.flatnonzero(rng < FLOOR))
            if (placed >= ESCAPED).any():
                raw = np.flatnonzero(placed >= ESCAPED)
                r = rng[raw] >> 16
                low[raw] += row[raw] * r
                rng[raw] = r
                shift(raw[r < FLOOR])
    for _ in range(3):
        at_out.append(np.arange(lanes, dtype=np.uint16))
        words.append((low >> 32).astype(np.uint32))
        low = (low & LOW) << 16
    lane = np.concatenate(at_out)
    data = np.concatenate(words)[np.argsort(lane, kind="stable")]
    sizes = np.bincount(lane, minlength=lanes)
    while (over := np.flatnonzero(data >> np.uint32(16))).size:  # a carry goes to the digit before, in the same lane
        data[over] &= np.uint32(0xFFFF)
        data[over - 1] += np.uint32(1)
    head = np.array([n, lanes, zlib.crc32(np.ascontiguousarray(ids, "<u4")), len(data)], "<i8").tobytes()
    return head + sizes.astype("<u4").tobytes() + data.astype("<u2").tobytes()


def decode(raw: bytes) -> np.ndarray:
    """The ids of a block; a wrong checksum raises ValueError."""
    n, lanes, crc, total = np.frombuffer(raw, "<i8", 4).tolist()
    sizes = np.frombuffer(raw, "<u4", lanes, 32).astype(np.int64)
    data = np.concatenate([np.frombuffer(raw, "<u2", total, 32 + 4 * lanes), np.zeros(8, np.uint16)])
    steps = -(-n // lanes)
    grid = np.zeros((steps, lanes), np.uint16)
    model = Model(lanes)
    rng = np.full(lanes, 1 << 48)
    at = np.cumsum(sizes) - sizes
    code = np.zeros(lanes, np.int64)
    for _ in range(3):
        code = code << 16 | data.take(at)
        at += 1

    def shift(where: np.ndarray) -> None:
        while len(where):
            own = at.take(where)
            code[where] = code.take(where) << 16 | data.take(own, mode="clip")
            at[where] = own + 1
            wide = rng.take(where) << 16
            rng[where] = wide
            where = where[wide < FLOOR]

    for t in range(steps):
        model.expect()
        r = rng >> 24
        slot = np.minimum((code / r).astype(np.int64), (1 << 24) - 1)  # as floor_div()
        row, start, width, coded = model.symbols(slot)
        code -= start * r
        rng = r * width
        shift(np.flatnonzero(rng < FLOOR))
        escaped = np.flatnonzero(row == 1 << 16)
        if len(escaped):
            r = rng[escaped] >> 16
            row[escaped] = np.minimum(code[escaped] // np.maximum(r, 1), 65535)
            code[escaped] -= row[escaped] * r
            rng[escaped] = r
            shift(escaped[r < FLOOR])
        grid[t] = row
        model.learn(row, coded)
    ids = grid.T.reshape(-1)[:n].astype("<u4")
    if zlib.crc32(ids) != crc:
        raise ValueError("checksum of a block differs")
    return ids
