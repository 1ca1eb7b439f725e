"""Items of varying size into containers of fixed capacity, by swap-based local search.

Items come in blocks (Arrow batches) of bounded size. A block is first packed
in its own order, each item into the fullest container that still takes it. Then
the emptiest container gives its items away to fuller ones: it moves an item,
exchanges one for a smaller one, two for one, or one for two, and each such step
moves size from a less to a more filled container, so the sum of squared fills
grows and the search ends. A container is gone once it is empty; the search
stops when no fewer containers can hold the block (by total size, and by items
of over half the capacity), or when no open container has an improving step
left. Pairs of equal sum are alike, so all pairs are searched at the cost of as
many as there are sums.

Containers filled to ``close_at`` (all but 0.2 %) are closed, the items of the
others go into the next block; what fills no container in its partition, at its
end or beyond ``carry`` items, is packed in a second round over all partitions,
mixed. Nothing is shuffled but those remainders (ids and sizes).

An item larger than the capacity is the only kind that is split: into full
containers and a rest that is packed like any item. Items of size 0 are put
into some container. Null sizes are left out, null and repeated ids are items
like any other. Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.shared import ship, staged

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How the texts of the rank files are cut before merging (given with the vocabularies).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SCHEMA = "doc_id bigint, piece int, first_token bigint, n_tokens int, container bigint"


@lru_cache(maxsize=4)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, tokenizer: str = TOKENIZER) -> Column:
    """Tokens of a text by the rank file ``tokenizer``, which must lie at this path on every machine."""

    @F.pandas_udf("bigint")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from rivulet.llm.packing import _encoding

        encode = _encoding(tokenizer).encode_ordinary
        for s in texts:
            yield pd.Series([None if t is None else len(encode(t)) for t in s], index=s.index, dtype="Int64")

    return count(text)


class Block:
    """Sizes and their containers while they are searched."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.size, self.cap = sizes.astype(np.int64), capacity
        self.at = np.empty(len(sizes), dtype=np.int64)
        self.fill = np.zeros(0, dtype=np.int64)
        self._first()

    def _first(self) -> None:
        """Each item, in its order, into the fullest container that takes it."""
        from bisect import bisect_left, insort

        room: list[tuple[int, int]] = []  # (room, container) of those with room
        fill: list[int] = []
        for k, s in enumerate(self.size.tolist()):
            j = bisect_left(room, (s, -1))
            if j < len(room):
                left, b = room.pop(j)
            else:
                left, b = self.cap, len(fill)
                fill.append(0)
            fill[b] += s
            self.at[k] = b
            if left > s or s == 0:
                insort(room, (left - s, b))
        self.fill = np.array(fill, dtype=np.int64)
        self.used = len(fill)

    def _move(self, item: int, to: int) -> None:
        self.fill[self.at[item]] -= self.size[item]
        self.fill[to] += self.size[item]
        self.at[item] = to

    def _step(self, giver: int) -> bool:
        """One improving step that takes size from the giver; False if there is none."""
        size, at, cap = self.size, self.at, self.cap
        mine = np.flatnonzero(at == giver)
        mine = mine[np.argsort(-size[mine], kind="stable")]
        room = np.where((self.fill >= self.fill[giver]) & (self.fill > 0), cap - self.fill, 0)
        room[giver] = 0
        if not room.any():
            return False
        for x in mine:  # move
            fit = np.flatnonzero(room >= size[x])
            if len(fit) and size[x] > 0:
                self._move(x, int(fit[np.argmin(room[fit])]))
                return True
        others = np.flatnonzero(room[at] > 0)
        if not len(others):
            return False
        others_size, others_room = size[others], room[at[others]]

        def exchange(given: list[int], amount: int) -> bool:
            gain = amount - others_size
            ok = np.flatnonzero((gain > 0) & (gain <= others_room))
            if not len(ok):
                return False
            y = int(others[ok[np.argmax(gain[ok])]])
            to = int(at[y])
            self._move(y, giver)
            for x in given:
                self._move(x, to)
            return True

        for amount in np.unique(size[mine])[::-1]:  # one for one
            if amount > 0 and exchange([int(mine[np.argmax(size[mine] == amount)])], int(amount)):
                return True
        # two for one: pairs of equal sum are alike, so there are no more of them than the capacity
        i, j = np.triu_indices(len(mine), 1)
        sums, first = np.unique(size[mine[i]] + size[mine[j]], return_index=True)
        # by the size taken back, the most that a container with such an item can take
        most = np.zeros(cap + 1, dtype=np.int64)
        np.maximum.at(most, others_size, others_room + others_size)
        held = np.flatnonzero(most)
        ok = (held[None, :] < sums[:, None]) & (most[held][None, :] >= sums[:, None]) if len(held) else np.zeros((len(sums), 0), dtype=bool)
        for k in np.flatnonzero(ok.any(axis=1))[::-1]:
            if exchange([int(mine[i[first[k]]]), int(mine[j[first[k]]])], int(sums[k])):
                return True
        # one for two of the same container: all pairs at once, those of neighbours d apart in the order by container
        amounts, whose = np.unique(size[mine], return_index=True)
        theirs = np.flatnonzero((room[at] > 0) & (size < amounts[-1]))
        theirs = theirs[np.argsort(at[theirs], kind="stable")]
        box = at[theirs]
        for d in range(1, len(theirs)):
            same = np.flatnonzero(box[d:] == box[:-d])
            if not len(same):
                break
            pair = size[theirs[same]] + size[theirs[same + d]]
            x = np.searchsorted(amounts, pair + room[box[same]], side="right") - 1
            gain = np.where(x >= 0, amounts[x], 0) - pair
            k = int(np.argmax(gain))
            if gain[k] > 0:
                to = int(box[same[k]])
                for y in (theirs[same[k]], theirs[same[k] + d]):
                    self._move(int(y), giver)
                self._move(int(mine[whose[x[k]]]), to)
                return True
        return False

    def search(self) -> None:
        """Until as few containers are left as can hold the block, or each open one has been tried since the last was emptied."""
        # no two items of over half the capacity share a container
        least = max(-(-int(self.size.sum()) // self.cap), int((2 * self.size > self.cap).sum()))
        stuck: set[int] = set()
        while self.used > max(least, 1):
            open_ = [b for b in np.flatnonzero((self.fill > 0) & (self.fill < self.cap)) if b not in stuck]
            if not open_:
                break
            giver = min(open_, key=lambda b: (self.fill[b], b))
            while self.fill[giver] > 0 and self._step(int(giver)):
                pass
            if self.fill[giver] == 0:
                self.used -= 1
                empty = np.flatnonzero(self.at == giver)  # items of size 0 stay with others
                if len(empty):
                    self.at[empty] = int(np.argmax(self.fill))
                stuck.clear()
            else:
                stuck.add(int(giver))


def _packer(capacity: int, close_at: float, carry: int, last_round: bool):
    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np
        import pandas as pd
        from pyspark import TaskContext

        from rivulet.llm.packing import Block

        base = (TaskContext.get().partitionId() << 33) | (int(last_round) << 32)
        used = 0
        columns = ["doc_id", "piece", "first_token", "n_tokens"]
        nothing = pd.DataFrame({"doc_id": pd.Series(dtype="Int64"), "piece": pd.Series(dtype="int64"), "first_token": pd.Series(dtype="int64"), "n_tokens": pd.Series(dtype="int64")})
        carried = nothing

        def search(rows: pd.DataFrame, all_of_them: bool):
            nonlocal used
            block = Block(rows["n_tokens"].to_numpy(dtype=np.int64), capacity)
            block.search()
            shut = (block.fill >= close_at * capacity) | all_of_them
            name = np.full(len(block.fill), -1, dtype=np.int64)
            name[shut] = base + used + np.arange(int(shut.sum()))
            used += int(shut.sum())
            where = name[block.at]
            return rows.assign(container=where)[where >= 0], rows[where < 0]

        for frame in frames:
            frame = frame.astype({"doc_id": "Int64"})
            if "piece" not in frame.columns:
                whole = frame["n_tokens"].to_numpy(dtype=np.int64) // capacity
                rest = frame["n_tokens"].to_numpy(dtype=np.int64) - whole * capacity
                big = np.flatnonzero(whole)
                if len(big):
                    times = whole[big]
                    piece = np.concatenate([np.arange(t) for t in times])
                    full = pd.DataFrame({"doc_id": frame["doc_id"].iloc[np.repeat(big, times)].to_numpy(), "piece": piece, "first_token": piece * capacity, "n_tokens": capacity, "container": base + used + np.arange(len(piece))})
                    used += len(piece)
                    yield full
                left = np.flatnonzero((rest > 0) | (whole == 0))
                frame = pd.DataFrame({"doc_id": frame["doc_id"].iloc[left].to_numpy(), "piece": whole[left], "first_token": whole[left] * capacity, "n_tokens": rest[left]})
            rows = pd.concat([carried, frame[columns]], ignore_index=True)
            done, carried = search(rows, False)
            if len(done):
                yield done
            if len(carried) > carry and not last_round:  # what fills no container here is left for the second round
                yield carried.assign(container=-1)
                carried = nothing
        if len(carried):
            if last_round:
                yield search(carried, True)[0]
            else:
                yield carried.assign(container=-1)

    return pack


def pack(items: DataFrame, capacity: int, close_at: float = 0.998, carry: int = 10_000) -> DataFrame:
    """SCHEMA for items (doc_id, n_tokens). close_at: the fill from which a container is closed; carry: items of open containers that are taken on to the next block, more wait for the second round."""
    ship(items.sparkSession)
    first = items.where("n_tokens is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("n_tokens").cast("bigint").alias("n_tokens"))
    packed = staged(first.mapInPandas(_packer(capacity, close_at, carry, False), SCHEMA), "packed")
    left = packed.where("container = -1").drop("container")
    # rows are dealt out evenly, so a task of the second round holds no more than about so many, of all sizes that are left
    tasks = max(1, -(-left.count() // 20_000))
    again = left.repartition(tasks).mapInPandas(_packer(capacity, close_at, carry, True), SCHEMA)
    return packed.where("container <> -1").unionByName(again)
