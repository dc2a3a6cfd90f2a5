"""Best-fit packing of documents into sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens
from .ans import _arrow

LENGTH = 1024
#: Pieces that are packed together, on average: the memory of one task, whatever the input.
SHARD = 2048
ISLANDS = 2
POPULATION = 4
EPOCHS = 3
GENERATIONS = 8
#: A bin is well filled from this share of its length.
WELL = 0.99
#: Bins that a mutation opens beside the emptiest.
OPENED = 3
#: Pairs that a snug bin tries for each place.
TRIES = 40


def lower_bound(sizes: np.ndarray, cap: int) -> int:
    """No packing has fewer bins: items that can't share, and what the others need beside them."""
    best = -(-int(sizes.sum()) // cap)
    for a in np.unique(sizes[sizes <= cap // 2]):
        alone = sizes > cap - a
        big = (sizes > cap // 2) & ~alone
        small = (sizes >= a) & (sizes <= cap // 2)
        room = cap * int(big.sum()) - int(sizes[big].sum())
        best = max(best, int(alone.sum() + big.sum()) + max(0, -(-(int(sizes[small].sum()) - room) // cap)))
    return best


def best_fit(order, sizes: list[int], assign: np.ndarray, fill: list[int], cap: int) -> None:
    """Put the items in turn where they leave least room; assign and fill are changed in place."""
    free: dict[int, list[int]] = {}
    mask = 0
    for b, f in enumerate(fill):
        if f < cap:
            free.setdefault(cap - f, []).append(b)
            mask |= 1 << (cap - f)
    for i in order:
        s = sizes[i]
        fits = mask >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            bins = free[room]
            b = bins.pop()
            if not bins:
                mask ^= 1 << room
        else:
            b, room = len(fill), cap
            fill.append(0)
        assign[i] = b
        fill[b] += s
        if room > s:
            free.setdefault(room - s, []).append(b)
            mask |= 1 << (room - s)


def _closed(assign: np.ndarray) -> np.ndarray:
    return np.unique(assign, return_inverse=True)[1].astype(np.int32)


def fitness(assign: np.ndarray, sizes: np.ndarray, cap: int) -> tuple[int, float]:
    """Bins, and minus the mean square of their fills: smaller is better."""
    fill = np.bincount(assign, weights=sizes)
    return len(fill), -float(np.mean((fill / cap) ** 2))


def cross(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, cap: int, rng) -> np.ndarray:
    """Inject whole well-filled bins of b into a; a's bins that hold any of their items go, and what
    they held besides is put back best-fit, largest first."""
    fill = np.bincount(b, weights=sizes)
    well = np.flatnonzero(fill >= WELL * cap)
    if not len(well):
        well = np.argsort(-fill)[: max(1, len(fill) // 4)]
    picked = rng.choice(well, max(1, int(len(well) * rng.uniform(0.2, 0.7))), replace=False)
    injected = np.zeros(len(fill), bool)
    injected[picked] = True
    moved = injected[b]
    hit = np.zeros(int(a.max()) + 1, bool)
    hit[a[moved]] = True
    out = np.where(moved, int(a.max()) + 1 + b, a)
    return refill(out, np.flatnonzero(hit[a] & ~moved), sizes, cap)


def refill(assign: np.ndarray, loose: np.ndarray, sizes: np.ndarray, cap: int, order=None) -> np.ndarray:
    kept = np.ones(len(assign), bool)
    kept[loose] = False
    out = np.zeros(len(assign), np.int32)
    out[kept] = _closed(assign[kept])
    fill = np.bincount(out[kept], weights=sizes[kept]).astype(int).tolist() if kept.any() else []
    order = loose[np.argsort(-sizes[loose], kind="stable")] if order is None else order
    best_fit(order.tolist(), sizes.tolist(), out, fill, cap)
    return out


def exchange(assign: np.ndarray, loose: np.ndarray, sizes: np.ndarray, cap: int, rng) -> tuple[np.ndarray, np.ndarray]:
    """Fill bins up by exchange with loose items: one or two of a bin's items for one or two loose ones that are longer together and
    still fit. What comes loose is shorter, so it goes in elsewhere more easily. assign, and the items now loose."""
    out, at = assign.copy(), sizes.tolist()
    waiting: dict[int, list[int]] = {}
    for i in loose.tolist():
        waiting.setdefault(at[i], []).append(i)
    mask = sum(1 << s for s in waiting)
    kept = np.ones(len(assign), bool)
    kept[loose] = False
    fill = np.bincount(assign[kept], weights=sizes[kept], minlength=int(assign.max()) + 1).astype(np.int64)
    open_ = np.flatnonzero((fill < cap) & (fill > 0))
    inside: dict[int, list[int]] = {b: [] for b in open_.tolist()}
    for i in np.flatnonzero(kept & np.isin(assign, open_)).tolist():
        inside[int(assign[i])].append(i)

    def take(size: int) -> int:
        nonlocal mask
        items = waiting[size]
        i = items.pop()
        if not items:
            del waiting[size]
            mask ^= 1 << size
        return i

    def longest(room: int) -> int:
        return (mask & ((2 << room) - 1)).bit_length() - 1 if room > 0 else -1

    for b in rng.permutation(open_).tolist():
        items, gap = inside[b], cap - int(fill[b])
        outs = [[i] for i in items] + [[i, j] for k, i in enumerate(items[:6]) for j in items[k + 1 : 6]]
        best: tuple[int, list[int], tuple[int, ...]] | None = None
        for gone in [[], *outs]:
            size = sum(at[i] for i in gone)
            room = size + gap
            one = longest(room)
            if one > size and (best is None or one - size > best[0]):
                best = (one - size, gone, (one,))
            if best is None or best[0] < gap:
                for first in list(waiting):
                    second = longest(room - first)
                    if second == first and len(waiting[first]) < 2:
                        continue
                    if second > 0 and first + second > size and (best is None or first + second - size > best[0]):
                        best = (first + second - size, gone, (first, second))
            if best is not None and best[0] == gap:
                break
        if best is not None:
            for s in best[2]:
                out[take(s)] = b
            for i in best[1]:
                waiting.setdefault(at[i], []).append(i)
                mask |= 1 << at[i]
    return out, np.array([i for items in waiting.values() for i in items], dtype=np.int64)


def mutate(a: np.ndarray, sizes: np.ndarray, cap: int, rng, opened: int = OPENED) -> np.ndarray:
    """Open the emptiest bin and a few others, fill the rest up by exchange, and put what is loose back best-fit."""
    fill = np.bincount(a, weights=sizes)
    gone = np.zeros(len(fill), bool)
    gone[int(fill.argmin())] = True
    gone[rng.integers(0, len(fill), opened)] = True
    out, loose = exchange(a, np.flatnonzero(gone[a]), sizes, cap, rng)
    return refill(out, loose, sizes, cap)


def evolve(pop: list[np.ndarray], sizes: np.ndarray, cap: int, rng, bound: int, generations: int = GENERATIONS) -> list[np.ndarray]:
    """The population after so many generations, best first; ends at once at the lower bound."""
    score = lambda x: fitness(x, sizes, cap)
    scored = sorted(((score(x), i, x) for i, x in enumerate(pop)), key=lambda y: y[:2])
    count = len(scored)
    for _ in range(generations):
        if scored[0][0][0] <= bound:
            break
        for _ in range(max(1, len(pop) // 2)):
            i, j = sorted(rng.integers(0, len(scored), 2))
            child = cross(scored[i][2], scored[j][2] if i != j else scored[(j + 1) % len(scored)][2], sizes, cap, rng)
            if rng.random() < 0.5:
                child = mutate(child, sizes, cap, rng)
            scored.append((score(child), count, child))
            count += 1
        seen, kept = set(), []
        for s in sorted(scored, key=lambda y: y[:2]):
            if s[0] not in seen:
                seen.add(s[0])
                kept.append(s)
        scored = kept[: len(pop)]
    return [x for _, _, x in scored]


def snug(sizes: np.ndarray, cap: int, rng, jump: float = 0.0) -> np.ndarray:
    """A packing bin by bin: the longest item left, then again and again the two that fill it best, of which the longer, and the other
    if the bin is full then. jump: how often the search starts further down, which makes packings differ."""
    waiting: dict[int, list[int]] = {}
    for i, s in enumerate(sizes.tolist()):
        waiting.setdefault(s, []).append(i)
    mask = sum(1 << s for s in waiting)
    out = np.zeros(len(sizes), np.int32)
    bin_ = 0

    def take(size: int) -> None:
        nonlocal mask
        out[waiting[size].pop()] = bin_
        if not waiting[size]:
            del waiting[size]
            mask ^= 1 << size

    def longest(room: int) -> int:
        return (mask & ((2 << room) - 1)).bit_length() - 1 if room > 0 else -1

    while mask:
        size = longest(cap)
        take(size)
        room = cap - size
        while (first := longest(room)) > 0:
            best = (first, first, 0)
            if jump and rng.random() < jump:
                first = longest(int(first * rng.uniform(0.5, 1)))
            for _ in range(TRIES):
                if first <= 0 or best[0] == room:
                    break
                second = longest(room - first)
                if second == first and len(waiting[first]) < 2:
                    second = longest(first - 1)
                best = max(best, (first + max(second, 0), first, max(second, 0)))
                first = longest(first - 1)
            take(best[1])
            if best[2] and best[0] == room:
                take(best[2])
                break
            room -= best[1]
        bin_ += 1
    return out


def first_population(sizes: np.ndarray, cap: int, rng, bound: int, count: int = POPULATION) -> list[np.ndarray]:
    """Best-fit decreasing, and snug packings of other shapes."""
    out = [refill(np.zeros(len(sizes), np.int32), np.arange(len(sizes)), sizes, cap)]
    for k in range(count - 1):
        if min(fitness(x, sizes, cap)[0] for x in out) <= bound:
            break
        out.append(snug(sizes, cap, rng, 0.1 * k))
    return sorted(out, key=lambda x: fitness(x, sizes, cap))


def cut_pieces(docs: DataFrame, path: str, length: int = LENGTH, end: int = tokens.END) -> DataFrame:
    """docs (doc_id, text) to a row a piece: doc_id, piece, start, length, ids_crc32. Null text is empty.

    Only documents over length are cut, into pieces of length; the first may be shorter.
    """

    def run(batches):
        enc = tokens.encoder(path)
        tail = np.array([end], "<u4").tobytes()
        for pdf in batches:
            rows = []
            for d, t in zip(pdf["doc_id"], pdf["text"]):
                ids = enc.encode(t or "") + tail
                n = len(ids) // 4
                stops = range((n - 1) % length + 1, n + 1, length)
                at = 0
                for k, stop in enumerate(stops):
                    rows.append((d, k, at, stop - at, zlib.crc32(ids[4 * at : 4 * stop])))
                    at = stop
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"], dtype=object)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_arrow(run, schema), schema)


def assign_bins(items: DataFrame, cap: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """items (uid, length below cap) to uid, sequence_id, offset.

    Items are dealt by hash into shards of bounded mean size; islands evolve each shard's packing
    and pass their elite on to the next island of the shard after each epoch.
    """
    n = items.count()
    shards = max(1, -(-n // shard))
    dealt = items.groupBy(F.pmod(F.xxhash64("uid"), F.lit(shards)).alias("shard")).agg(F.sort_array(F.collect_list(F.struct("length", "uid")), asc=False).alias("items"))
    dealt = common.save(dealt.select("shard", F.col("items.length").alias("sizes"), F.col("items.uid").alias("uids")), "pack-shards")

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                sizes = np.asarray(r.sizes, dtype=np.int64)
                bound = lower_bound(sizes, cap)
                rng = np.random.default_rng([int(r.shard), int(r.island), int(r.epoch)])
                if r.pop is None:
                    pop = first_population(sizes, cap, rng, bound)
                else:
                    pop = list(np.frombuffer(r.pop, "<i4").reshape(-1, len(sizes)))
                if r.migrant is not None:
                    migrant = np.frombuffer(r.migrant, "<i4")
                    if not any(np.array_equal(migrant, x) for x in pop):
                        pop = [*pop[: max(1, len(pop) - 1)], migrant]
                if len(pop) > 1:
                    pop = evolve(pop, sizes, cap, rng, bound)
                bins, spread = fitness(pop[0], sizes, cap)
                yield pd.DataFrame({"shard": [r.shard], "island": [r.island], "pop": [np.stack(pop).astype("<i4").tobytes()], "elite": [pop[0].astype("<i4").tobytes()], "bins": [bins], "spread": [spread], "done": [bins <= bound]})

    out_schema = "shard long, island int, pop binary, elite binary, bins long, spread double, done boolean"
    none = F.lit(None).cast("binary")
    state = dealt.select("shard", "sizes", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), none.alias("pop"), none.alias("migrant"), F.lit(0).alias("epoch"))
    state = common.save(state.mapInPandas(run, out_schema), "pack-epoch")
    ring = Window.partitionBy("shard").orderBy("island")
    for epoch in range(1, EPOCHS):
        whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        passed = state.withColumns({"migrant": F.coalesce(F.lag("elite").over(ring), F.last("elite").over(whole)), "any": F.max("done").over(Window.partitionBy("shard"))})
        ended = passed.filter("any").select(*state.columns)  # a shard at its lower bound is left as it is
        live = passed.filter("not any").join(dealt.select("shard", "sizes"), "shard").select("shard", "sizes", "island", "pop", "migrant", F.lit(epoch).alias("epoch"))
        state = common.save(live.mapInPandas(run, out_schema).unionByName(ended), "pack-epoch")
    best = state.groupBy("shard").agg(F.min_by("elite", F.struct("bins", "spread", "island")).alias("elite"))

    def place(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                bins = np.frombuffer(r.elite, "<i4").astype(np.int64)
                sizes = np.asarray(r.sizes, dtype=np.int64)
                order = np.argsort(bins, kind="stable")
                upto = np.cumsum(sizes[order]) - sizes[order]
                first = np.concatenate([[True], np.diff(bins[order]) > 0])
                offset = np.empty_like(sizes)
                offset[order] = upto - np.maximum.accumulate(np.where(first, upto, 0))
                yield pd.DataFrame({"uid": np.asarray(r.uids, dtype=np.int64), "sequence_id": (int(r.shard) << 24) + bins, "offset": offset})

    return dealt.join(best, "shard").mapInPandas(place, "uid long, sequence_id long, offset long")


def pack(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Other columns of docs are left out, whatever their names. Repeated rows are packed as often as they stand there; null
    text is empty (its end id only); no documents give no rows. Whole pieces are sequences of their own.
    """
    pieces = common.save(cut_pieces(docs, path, length).withColumn("uid", F.monotonically_increasing_id()), "pack-pieces")
    part = common.save(assign_bins(pieces.filter(F.col("length") < length).select("uid", "length"), length), "pack-places")
    full = pieces.filter(F.col("length") >= length).select("*", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    out = pieces.filter(F.col("length") < length).join(part, "uid").select(*pieces.columns, "sequence_id", "offset").unionByName(full)
    return out.drop("uid")


def op3_pack(spark, sf_dir: str) -> DataFrame:
    """pack of the whole table documents; nulls, repeated rows and empty tables as stated there."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(docs, tokens.path_of("byte_bpe_50k.json"))
