"""Gaps in delivery numbers on a stream."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


#: Open gaps of a key that lie in one entry of the state, about.
BLOCK = 8192
_GAP, _ENTRY = 3, 3


def _unpacked(packed: bytes, width: int) -> np.ndarray:
    return np.frombuffer(packed, np.int64).reshape(width, -1)


class GapDetector(StatefulProcessor):
    """Open gaps of a key, each with a time until which it may still be filled.

    A number beyond those seen opens a gap over what is missing between; one inside a gap closes it, cuts it at an end or
    splits it. A gap that is still open when the watermark passes its time is lost and leaves the state, so the state holds the
    gaps of a grace period. Numbers within a batch count as come together.

    Gaps are held in blocks, as arrays of first number, last number and time in the order of numbers. An index tells of each block
    its smallest first number, its name and its earliest time, so a batch reads and writes the blocks that it touches, once each.
    """

    def __init__(self, key: str, grace_millis: int):
        self.key, self.grace = key, grace_millis

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "low long, high long, revision long, named long, timer long, entries binary")
        self.blocks = handle.getMapState("blocks", "name long", "gaps binary")

    def _told(self, key: tuple, changes: list[tuple[np.ndarray, str]], revision: int) -> Iterator[pd.DataFrame]:
        """Changes, as arrays of gaps with a state, in the order given; revisions rise by one."""
        for gaps, state in changes:
            for k in range(0, gaps.shape[1], 100_000):
                part = gaps[:, k : k + 100_000]
                n = part.shape[1]
                states = state[k : k + n] if isinstance(state, np.ndarray) else state
                yield pd.DataFrame({self.key: [key[0]] * n, "gap_from": part[0], "gap_to": part[1], "state": states, "revision": np.arange(revision + 1, revision + 1 + n)})
                revision += n

    def _put(self, name: int, gaps: np.ndarray, named: int) -> tuple[list[tuple[int, int, int]], int]:
        """Writes what a block has become, as several blocks if it has grown; returns their entries and how many names are given."""
        if not gaps.shape[1]:
            self.blocks.removeKey((name,))
            return [], named
        entries = []
        for part in np.array_split(gaps, -(-gaps.shape[1] // BLOCK) if gaps.shape[1] > 2 * BLOCK else 1, axis=1):
            self.blocks.updateValue((name,), (np.ascontiguousarray(part).tobytes(),))
            entries.append((int(part[0, 0]), name, int(part[2].min())))
            name, named = named, named + 1
        return entries, named - 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat([r[["seq", "at"]] for r in rows]).groupby("seq", as_index=False)["at"].min()
        numbers, at = batch["seq"].to_numpy(np.int64), batch["at"].to_numpy(np.int64)
        known = self.seen.exists()
        low, high, revision, named, timer, packed = self.seen.get() if known else (int(numbers[0]), int(numbers[0]), 0, 0, None, b"")
        entries = _unpacked(packed, _ENTRY)
        # numbers beyond the known stretch open gaps, which may be filled until a grace period after the number that shows them
        above, below = numbers > high, numbers < low
        over = _between(np.r_[high, numbers[above]], at[above] + self.grace)
        under = _between(np.r_[numbers[below], low], at[below] + self.grace)
        # numbers inside it fill gaps; a gap is in the block with the greatest first number up to its own
        late = numbers[~above & ~below] if known else numbers[:0]
        of = np.searchsorted(entries[0], late, "right") - 1
        late, of = late[of >= 0], of[of >= 0]
        touched = set(np.unique(of).tolist())
        count = entries.shape[1]
        ends = ({0} if under.shape[1] else set()) | ({max(count - 1, 0)} if over.shape[1] else set())
        after: list[tuple[int, int, int]] = []
        filled: list[tuple[np.ndarray, np.ndarray]] = []
        for k in range(max(count, 1)):
            if k not in touched and k not in ends:
                after += [tuple(entries[:, k].tolist())] if k < count else []
                continue
            name = int(entries[1, k]) if k < count else named
            named += k >= count
            before = gaps = _unpacked(self.blocks.getValue((name,))[0], _GAP) if k < count else np.zeros((_GAP, 0), np.int64)
            if k in touched:
                gaps, changes = _filled(gaps, late[slice(*np.searchsorted(of, [k, k + 1]))])
                if changes is not None:
                    filled.append(changes)
            if k in ends:
                gaps = np.concatenate([under if k == 0 else under[:, :0], gaps, over if k == max(count - 1, 0) else over[:, :0]], axis=1)
            if gaps is before:
                after.append(tuple(entries[:, k].tolist()))
            else:
                made, named = self._put(name, gaps, named)
                after += made
        opened = [(x, "open") for x in (over, under)]
        soonest = min((int(x[2].min()) for x, _ in opened if x.shape[1]), default=None)
        if soonest is not None and (timer is None or soonest < timer):
            self.handle.registerTimer(soonest)
            timer = soonest
        changes = [*filled, *opened]
        now = revision + sum(x.shape[1] for x, _ in changes)
        self.seen.update((min(low, int(numbers[0])), max(high, int(numbers[-1])), now, named, timer, np.array(after, np.int64).reshape(-1, _ENTRY).T.tobytes()))
        yield from self._told(key, changes, revision)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Loses gaps whose time has come. One timer stands at the earliest time, and at the next one thereafter."""
        low, high, revision, named, timer, packed = self.seen.get()
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        after, lost = [], [np.zeros((_GAP, 0), np.int64)]
        for entry in _unpacked(packed, _ENTRY).T.tolist():
            if entry[2] > now:
                after.append(tuple(entry))
                continue
            gaps = _unpacked(self.blocks.getValue((entry[1],))[0], _GAP)
            lost.append(gaps[:, gaps[2] <= now])
            made, named = self._put(entry[1], gaps[:, gaps[2] > now], named)
            after += made
        gone = np.concatenate(lost, axis=1)
        gone = gone[:, np.lexsort((gone[0], gone[2]))]
        # a timer beyond now is one that stands
        if timer is None or timer <= now:
            timer = min((e[2] for e in after), default=None)
            if timer is not None:
                self.handle.registerTimer(timer)
        self.seen.update((low, high, revision + gone.shape[1], named, timer, np.array(after, np.int64).reshape(-1, _ENTRY).T.tobytes()))
        yield from self._told(key, [(gone, "lost")], revision)

    def close(self) -> None:
        pass


def _between(edges: np.ndarray, until: np.ndarray) -> np.ndarray:
    """Gaps between rising numbers that are not neighbours, with the times that belong to the spaces between."""
    wide = np.diff(edges) > 1
    return np.stack([edges[:-1][wide] + 1, edges[1:][wide] - 1, until[wide]])


def _filled(gaps: np.ndarray, late: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray] | None]:
    """What numbers leave of gaps, and the changes with their states, None without any: a gap whose first number came is closed, and
    what is left of one is open anew."""
    start, end, until = gaps
    at = np.searchsorted(start, late, "right") - 1
    inside = (at >= 0) & (late <= end[at])
    n, at = late[inside], at[inside]
    if not len(n):
        return gaps, None
    first, last = np.r_[True, at[1:] != at[:-1]], np.r_[at[1:] != at[:-1], True]
    left = np.concatenate([np.stack([np.where(first, start[at], np.r_[0, n[:-1]] + 1), n - 1, until[at]]), np.stack([n[last] + 1, end[at[last]], until[at[last]]])], axis=1)
    left = left[:, left[0] <= left[1]]
    gone = at[first & (n == start[at])]
    changes, states = np.concatenate([gaps[:, gone], left], axis=1), np.repeat(np.array(["closed", "open"], object), [len(gone), left.shape[1]])
    order = np.argsort(changes[0], kind="stable")
    kept = np.concatenate([np.delete(gaps, at[first], axis=1), left], axis=1)
    return kept[:, np.argsort(kept[0], kind="stable")], (changes[:, order], states[order])


def gap_stream(stream: DataFrame, key: str, seq: str, time: str = "received_at", grace_seconds: int = 60, delay: str = "10 seconds") -> DataFrame:
    """Changes of gaps as rows of key, gap_from, gap_to, state (open, closed, lost) and revision, rising within a key; the last row of
    a gap_from tells what became of it."""
    kind = stream.schema[key].dataType.simpleString()
    slim = stream.withWatermark(time, delay).select(F.col(key), F.col(seq).cast("long").alias("seq"), F.unix_millis(time).alias("at"), F.col(time))
    return slim.groupBy(key).transformWithStateInPandas(GapDetector(key, grace_seconds * 1000), f"{key} {kind}, gap_from long, gap_to long, state string, revision long", "Update", "EventTime")


def standing_gaps(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Gaps that nothing has filled."""
    last = changes.groupBy(*keys, "gap_from").agg(F.max_by(F.struct("gap_to", "state"), "revision").alias("l"))
    return last.where("l.state <> 'closed'").select(*keys, "gap_from", F.col("l.gap_to").alias("gap_to"))
