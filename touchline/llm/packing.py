"""Problem 6: items of varying length combined into containers of fixed capacity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from touchline.llm.tokens import VOCABULARY, encoder
from touchline.session import shuffle_parts

#: Documents that are packed together; a document's shard is a hash, so all are about as large.
SHARD_ROWS = 50_000
#: Copies of one document that go to a shard as one row with their number.
COPIES = 1000
#: Sizes that the configurations are made of, and the share of the capacity up to which an item is small.
GROUPS, SMALL = 120, 1 / 8
#: Steps into which a capacity is divided when configurations are searched.
STEPS = 4096


def _best_fill(value: np.ndarray, size: np.ndarray, limit: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The counts of each size, at most ``limit``, that fit the capacity with the largest value."""
    best = np.zeros(capacity + 1)
    taken: list[tuple[int, int, np.ndarray]] = []
    for g in np.flatnonzero(value > 1e-12):
        left, m = int(min(limit[g], capacity // size[g])), 1
        while left > 0:
            m = min(m, left)
            room = m * int(size[g])
            with_it = best[: capacity + 1 - room] + m * value[g]
            better = np.zeros(capacity + 1, bool)
            better[room:] = with_it > best[room:] + 1e-12
            best[room:] = np.maximum(best[room:], with_it)
            taken.append((g, m, better))
            left, m = left - m, 2 * m
    counts, room = np.zeros(len(size), np.int64), capacity
    for g, m, better in reversed(taken):
        if better[room]:
            counts[g] += m
            room -= m * int(size[g])
    return counts, float(best[capacity])


def configurations(size: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(counts of each size, times used): few configurations that together meet the demand.

    The linear programme over all configurations is solved by generating columns: a basis of one
    configuration for each size is priced, the best-priced new configuration is a knapsack, and it
    enters until none improves. Its rounded-down solution is kept; what then is still to be met is
    filled by one fullest configuration after another, each as often as the demand allows.
    """
    k = len(size)
    basis = np.diag((capacity // size).astype(float))
    use = demand / np.diag(basis)
    unlimited = np.full(k, capacity)
    for _ in range(40 * k):
        price = np.linalg.solve(basis.T, np.ones(k))
        column, worth = _best_fill(np.maximum(price, 0), size, unlimited, capacity)
        if worth <= 1 + 1e-7:
            break
        change = np.linalg.solve(basis, column.astype(float))
        ratio = np.where(change > 1e-9, use / np.where(change > 1e-9, change, 1), np.inf)
        out = int(np.argmin(ratio))
        step = ratio[out]
        use = np.maximum(use - step * change, 0)
        use[out] = step
        basis[:, out] = column
    chosen, left = [], demand.astype(np.int64).copy()
    for j in np.argsort(-use):
        column = np.rint(basis[:, j]).astype(np.int64)
        fits = int(min(left[column > 0] // column[column > 0])) if column.any() else 0
        if times := min(int(use[j] + 1e-6), fits):
            chosen.append((column, times))
            left -= times * column
    while left.any():
        column, _ = _best_fill(size.astype(float), size, left, capacity)
        times = int(min(left[column > 0] // column[column > 0]))
        chosen.append((column, times))
        left -= times * column
    return chosen


def pack(tokens: np.ndarray, capacity: int, groups: int = GROUPS, small: float = SMALL) -> np.ndarray:
    """The container of each item; no item may exceed the capacity.

    Large items, sorted by size, form groups of equal number, and count as the largest of their
    group. Configurations of these few sizes are optimised and real items put in their places, the
    last place of a container taking the largest item that fits. What is left, small items above
    all, goes from the largest down where it leaves the least room, or opens a container where it
    fits nowhere.
    """
    place = np.full(len(tokens), -1, np.int64)
    room: list[int] = []
    large = np.flatnonzero(tokens > capacity * small)
    if large.size:
        large = large[np.argsort(-tokens[large], kind="stable")]
        changes = np.r_[True, np.diff(tokens[large]) != 0]
        # few sizes need no rounding
        group = np.cumsum(changes) - 1 if changes.sum() <= groups else np.arange(large.size) * groups // large.size
        rounded = np.maximum.reduceat(tokens[large], np.flatnonzero(np.r_[True, np.diff(group) > 0]))
        unit = max(1, -(-capacity // STEPS))
        steps = capacity // unit
        scaled = np.minimum(-(-rounded // unit), steps)
        size, kind = np.unique(scaled, return_inverse=True)
        most = np.minimum(size * unit, capacity).tolist()
        demand = np.bincount(kind[group], minlength=len(size))
        waiting: dict[int, list[int]] = {}
        for item, n in zip(large.tolist(), tokens[large].tolist()):
            waiting.setdefault(n, []).append(item)
        sizes = sum(1 << n for n in waiting)  # the sizes of which an item waits
        for column, times in configurations(size, demand, steps):
            slots = [most[i] for i in range(len(column) - 1, -1, -1) for _ in range(column[i])]
            for _ in range(times if sizes else 0):
                left = capacity
                for j, limit in enumerate(slots):
                    # a place takes the largest item of its size, the last one the largest that fits
                    fits = sizes & ((2 << (left if j == len(slots) - 1 else min(left, limit))) - 1)
                    if not fits:
                        continue
                    n = fits.bit_length() - 1
                    place[waiting[n].pop()] = len(room)
                    if not waiting[n]:
                        sizes &= ~(1 << n)
                    left -= n
                if left < capacity:
                    room.append(left)
    rest = np.flatnonzero(place < 0)
    rest = rest[np.argsort(-tokens[rest], kind="stable")]
    by_room: dict[int, list[int]] = {}
    for c, left in enumerate(room):
        by_room.setdefault(left, []).append(c)
    bits = sum(1 << left for left in by_room)  # the rooms for which there is a container
    for item, n in zip(rest.tolist(), tokens[rest].tolist()):
        above = bits >> n
        if above:
            left = n + (above & -above).bit_length() - 1
            stack = by_room[left]
            c = stack.pop()
            if not stack:
                bits &= ~(1 << left)
        else:
            c, left = len(room), capacity
            room.append(capacity)
        place[item] = c
        left -= n
        stack = by_room.setdefault(left, [])
        if not stack:
            bits |= 1 << left
        stack.append(c)
    return place


def _cuts(n: int, capacity: int, inside: set[int]) -> list[int]:
    """Where the pieces of a text begin, and its end: full containers, but for cuts that would fall in a character."""
    if not inside:
        return [*range(0, n, capacity), n]
    cuts = [0]
    while n - cuts[-1] > capacity:
        full = at = cuts[-1] + capacity
        while at in inside and at - 1 > cuts[-1]:
            at -= 1
        cuts.append(full if at in inside else at)
    return [*cuts, n]


def pack_documents(
    sizes: DataFrame, id_col: str, tokens: str, limits: list[tuple[str, int]], shard_rows: int = SHARD_ROWS, inside: str | None = None, between: int = 1, key: str | None = None
) -> DataFrame:
    """Documents in containers: one row per document, or per piece of one that exceeds a container.

    Returns profile string, capacity int, container_id long (of its profile), ``id_col``, piece int,
    token_from long, token_to long (end excluded), n_tokens long. ``limits`` are (profile, capacity)
    pairs; those with a null or a capacity below one are passed over.

    A text above the capacity is divided into full containers and a rest that is packed like any
    other item; others are never divided. ``inside`` names an array column with the token positions
    within a character (``token_sizes``); such a cut moves before that character, so that no piece
    gains tokens by being encoded again. What stands between the texts of a container takes
    ``between`` tokens of its room each time.

    Documents spread by a hash of all that tells them apart over shards of about ``shard_rows``, and
    each shard is packed for each profile by itself, in order of size and hash; so the result
    depends on the rows alone, not on their order, files or tasks, and a task that runs again gives
    the same. Rows equal in id, size and text are counted first and go on as one row for each 1,000
    of them, so that a document that a third of all rows repeat is no hot shard. Only the last
    containers of a shard can stay open, so sharding costs next to nothing. A null size is left out,
    an empty text takes a place of no tokens. Equal ids are packed as different items; ``key`` names
    a column (``text_key``) that tells them apart and comes out too. Empty input: no rows. Other
    columns are not read.
    """
    limits = [(p, int(c)) for p, c in limits if p is not None and c is not None and c > 0]
    spark = sizes.sparkSession
    kind = sizes.schema[id_col].dataType
    tag = [T.StructField(key, T.LongType())] if key else []
    out = T.StructType(
        [
            T.StructField("profile", T.StringType()),
            T.StructField("capacity", T.IntegerType()),
            T.StructField("container_id", T.LongType()),
            T.StructField(id_col, kind),
            T.StructField("piece", T.IntegerType()),
            T.StructField("token_from", T.LongType()),
            T.StructField("token_to", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            *tag,
        ]
    )
    marks = (F.col(inside) if inside else F.lit(None)).cast("array<int>").alias("inside")
    known = sizes.filter(F.col(tokens) >= 0).select(F.col(id_col).alias("id"), F.col(tokens).cast("long").alias("n"), marks, (F.col(key) if key else F.lit(None)).cast("long").alias("key"))
    if not limits:
        return spark.createDataFrame([], out)
    shards = max(1, -(-known.count() // shard_rows))
    same = ["id", "n", "inside", "key"]
    blocks = known.groupBy(*same).agg(F.count(F.lit(1)).alias("c")).select(*same, "c", F.explode(F.sequence(F.lit(0), F.floor((F.col("c") - 1) / COPIES))).alias("block"))
    counted = blocks.withColumns(
        {
            "times": F.least(F.lit(COPIES), F.col("c") - F.col("block") * COPIES),
            "h": F.xxhash64("id", "key", "inside"),
            "shard": F.pmod(F.xxhash64(*same, "block"), F.lit(shards)),
        }
    )
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("profile"), F.lit(c).alias("capacity")) for i, (p, c) in enumerate(limits)])).alias("limit")
    divided = F.when(F.col("n") > F.col("limit.capacity"), F.col("inside")).alias("inside")
    unit = (F.col("shard") * len(limits) + F.col("limit.i")).alias("unit")
    items = counted.select("*", each).select(unit, "id", "key", "n", "h", "block", "times", "shard", "limit.profile", "limit.capacity", divided)
    # a shard and profile is a unit of work; units are dealt out evenly, not by hash
    tasks = min(shards * len(limits), max(shuffle_parts(spark), len(limits)))
    dealt = items.repartitionById(tasks, F.pmod("unit", F.lit(tasks)).cast("int")).sortWithinPartitions("unit", F.desc("n"), "h", "block")
    wanted = to_arrow_schema(out)

    def fill(table: pa.Table) -> pa.Table:
        row = np.repeat(np.arange(table.num_rows), np.asarray(table["times"]))
        n = np.asarray(table["n"]).astype(np.int64)
        capacity, shard = table["capacity"][0].as_py(), table["shard"][0].as_py()
        long = np.flatnonzero(n > capacity)
        cuts = dict(zip(long.tolist(), ([*_cuts(n[d].item(), capacity, set(x or ()))] for d, x in zip(long, table["inside"].take(pa.array(long)).to_pylist()))))
        full = np.zeros(len(n), np.int64)
        full[long] = [len(c) - 2 for c in cuts.values()]
        last = np.zeros(len(n), np.int64)  # where a text's last piece begins
        last[long] = [c[-2] for c in cuts.values()]
        n, full, last = n[row], full[row], last[row]
        full_doc = np.repeat(np.arange(len(row)), full)
        full_piece = np.arange(full_doc.size) - np.repeat(np.cumsum(full) - full, full)
        # a text and what stands before the next one; the last text of a container needs no such room
        place = pack(n - last + between, capacity + between)
        doc = np.concatenate((full_doc, np.arange(len(row))))
        piece = np.concatenate((full_piece, full))
        container = np.concatenate((np.arange(full_doc.size), full_doc.size + place)) + (shard << 32)
        whole = [cuts[r] for r in row.tolist() if r in cuts] if cuts else []
        start = np.concatenate((np.array([x for c in whole for x in c[:-2]], np.int64), last))
        end = np.concatenate((np.array([x for c in whole for x in c[1:-1]], np.int64), n))
        of = pa.array(row[doc])
        columns = [
            pa.repeat(table["profile"][0], doc.size),
            pa.repeat(table["capacity"][0], doc.size),
            pa.array(container),
            table["id"].take(of),
            pa.array(piece),
            pa.array(start),
            pa.array(end),
            pa.array(end - start),
        ]
        if key:
            columns.append(table["key"].take(of))
        return pa.Table.from_arrays(columns, names=wanted.names).cast(wanted)

    def fill_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # the rows of one unit, which may go on in the next batch
        for batch in batches:
            table = pa.Table.from_batches([batch])
            units = np.asarray(table["unit"])
            for a, b in zip((cut := [0, *(np.flatnonzero(np.diff(units)) + 1).tolist(), len(units)]), cut[1:]):
                if held and b > a and held[0]["unit"][0].as_py() != units[a]:
                    yield from fill(pa.concat_tables(held).combine_chunks()).to_batches()
                    held = []
                if b > a:
                    held.append(table.slice(a, b - a))
        if held:
            yield from fill(pa.concat_tables(held).combine_chunks()).to_batches()

    return dealt.mapInArrow(fill_units, out)


def text_key(text: Column | str) -> Column:
    """What tells documents of one id apart: a 64-bit hash of the text."""
    return F.xxhash64(text)


def combine_texts(
    packed: DataFrame, documents: DataFrame, id_col: str, text: str, vocabulary: str = VOCABULARY, between: str = "\n", key: str | None = None
) -> DataFrame:
    """One row per container with its texts: profile, capacity, container_id, n_texts, n_tokens, text.

    Texts follow one another in order of document and piece, with ``between`` between them, for
    which ``pack_documents`` has to leave its tokens; n_tokens are those of the texts alone. A
    document that was divided is cut where its tokens are, at the start of the character in which
    a cut falls, so that its pieces in order are the whole text again. Texts move twice, to their
    pieces and to their container; a container's text is bounded by its capacity. Null ids
    meet one another. ``key`` names the column of ``packed`` with the ``text_key``, by which several
    documents of one id each keep their text; without it different texts of one id are an error.
    """
    # an id as text that is never null, so that plain equality joins in the partitions of the grouping
    on, name = ["__tl_id", "__tl_key"], F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("")).alias("__tl_id")
    known_texts = documents.filter(F.col(text).isNotNull()).select(name, (text_key(text) if key else F.lit(0)).alias("__tl_key"), F.col(text).alias("t"))
    least = F.min("t") if key else F.when(F.min("t") == F.max("t"), F.min("t")).otherwise(F.raise_error(F.lit(f"different texts of one {id_col}: give a key")))
    texts = known_texts.groupBy(*on).agg(least.alias("t"))
    mine = packed.select("*", name, (F.col(key) if key else F.lit(0)).alias("__tl_key"))

    def cut(body: pa.Array, start: pa.Array, end: pa.Array) -> pa.Array:
        encoding = encoder(vocabulary)
        known: dict[str, tuple[bytes, np.ndarray]] = {}  # each text of the batch is encoded once
        out = []
        for t, a, b in zip(body.to_pylist(), start.to_pylist(), end.to_pylist()):
            if t is None:
                out.append(None)
                continue
            if t not in known:
                sizes = [len(x) for x in encoding.decode_tokens_bytes(encoding.encode_ordinary(t))]
                known[t] = t.encode(), np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
            raw, ends = known[t]
            at = [int(ends[a]), int(ends[b])]
            for i in (0, 1):
                while at[i] < len(raw) and raw[at[i]] & 0xC0 == 0x80:
                    at[i] -= 1
            out.append(raw[at[0] : at[1]].decode())
        return pa.array(out, pa.string())

    cut.__annotations__ = {"body": pa.Array, "start": pa.Array, "end": pa.Array, "return": pa.Array}
    # pieces of more than one are few: a token span that isn't the whole text needs the tokenizer,
    # and only these texts go to Python
    divided = mine.filter("piece > 0").select(*on).distinct().withColumn("d", F.lit(True))
    known = mine.join(texts, on).join(divided, on, "left")
    part = F.arrow_udf(cut, T.StringType())(F.when(F.col("d"), F.col("t")), "token_from", "token_to")
    pieces = known.withColumn("t", F.coalesce(part, "t"))
    item = F.struct(F.col(id_col).alias("i"), F.col("piece").alias("p"), F.col("t").alias("t"))
    grouped = pieces.groupBy("profile", "capacity", "container_id").agg(F.sort_array(F.collect_list(item)).alias("l"), F.sum("n_tokens").alias("n_tokens"))
    body = F.array_join(F.transform("l", lambda x: x.t), between)
    return grouped.select("profile", "capacity", "container_id", F.size("l").alias("n_texts"), "n_tokens", body.alias("text"))


def packing_report(packed: DataFrame, between: int = 1) -> DataFrame:
    """For each profile: containers, tokens, share of room used, and the least number of containers.

    Returns profile, capacity, n_containers, n_pieces, n_tokens, least_containers (room that the
    pieces need over the room there is, rounded up) as longs, used_share double, of the texts and
    the ``between`` tokens from each to the next, and text_share double, of the texts alone.
    """
    by_container = packed.groupBy("profile", "capacity", "container_id").agg(
        F.count(F.lit(1)).alias("k"), F.sum("n_tokens").alias("t")
    )
    totals = by_container.groupBy("profile", "capacity").agg(
        F.count(F.lit(1)).alias("n_containers"), F.sum("k").alias("n_pieces"), F.sum("t").alias("n_tokens")
    )
    # each container has room for one separator that its last piece doesn't need
    least = F.ceil((F.col("n_tokens") + between * F.col("n_pieces")) / (F.col("capacity") + between))
    room = F.col("n_containers") * F.col("capacity")
    used = (F.col("n_tokens") + between * (F.col("n_pieces") - F.col("n_containers"))) / room
    return totals.withColumns({"least_containers": least, "used_share": used, "text_share": F.col("n_tokens") / room})


def containers(packed: DataFrame, id_col: str, between: int = 1) -> DataFrame:
    """One row per container: its pieces in order, their tokens, and the room that they and the
    ``between`` tokens from each to the next leave unused.
    """
    piece = F.struct(F.col(id_col), "piece", "token_from", "token_to")
    grouped = packed.groupBy("profile", "capacity", "container_id").agg(
        F.sort_array(F.collect_list(piece)).alias("pieces"), F.sum("n_tokens").alias("n_tokens")
    )
    return grouped.withColumn("unused", F.col("capacity") - F.col("n_tokens") - between * (F.size("pieces") - 1))
