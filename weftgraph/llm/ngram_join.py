"""Self-join of documents on the Jaccard similarity of their word shingles.

Two documents link when 100 * intersection >= percent * union of their sets of distinct shingles (five words; the whole
sequence if there are fewer). Documents with one set are one class, named by a 128-bit digest of its sorted hashes.

1. Every class deals its shingle hashes to buckets; a bucket counts in how many classes each hash occurs and tells
   the classes which of theirs are shared.
2. In an order by rising counts, the first n - ceil(0.8 n) + 1 shingles of two linked sets have one in common; shingles
   of a single class come first and need no look-up, so a class looks up only what is left of that prefix, its rarest
   shared shingles. A class with less than 80 % of its shingles shared looks up nothing.
3. Classes of equal or adjacent size bands that meet on such a shingle form candidate components. A component's classes go to tiles by size band (sizes
   of linked sets differ by a quarter at most, so only equal and adjacent bands meet) and, where a band is large, by salt.
   One class of each band stands in all its tiles, so that a large group of near copies is one known part after a pass that
   grows with the group; only classes outside the largest part of their component then visit the other tiles.
4. Within a tile, bit counts of hashed bitmap signatures bound the overlap from above (each bit in which two signatures
   differ stands for a shingle that only one of them has); pairs that pass are settled by intersecting sorted arrays.
   Pairs already known to be connected are skipped.

Defined results: null text counts as empty; without words a set is empty and links with nothing; null identifiers take
part, but are no component's name unless all its identifiers are null; repeated identifiers give a row each; an empty
table gives no rows; extra columns are ignored by ``link`` and kept by ``keep_one``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import Scratch, fresh, release, shuffle_partitions, trimmed
from weftgraph.llm.components import connected_components
from weftgraph.llm.packing import slices
from weftgraph.llm.words import BASE, hash_words, mix

WIDTH = 5
PERCENT = 80
#: Hashes that a task gathers before it deals them to buckets, and that a bucket sorts at once.
GATHERED = 1_000_000
#: A bucket has about so many hashes, 16 MB, however large the corpus.
BUCKET_HASHES = 4_000_000
#: A tile holds at most about so many sets and hashes; beyond, its component is dealt by size band and salt.
TILE_SETS, TILE_HASHES = 2048, 4_000_000
#: Rows are sent to all executors only up to this number (about 100 bytes each); beyond, the join shuffles.
BROADCAST_ROWS = 200_000

def shingle_sets(texts: Sequence[str | None], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles."""
    words, counts = hash_words(texts)

    def spans(first: np.ndarray, span: int) -> np.ndarray:
        """Hashes of the runs of ``span`` words from each place in ``first``."""
        with np.errstate(over="ignore"):
            h = np.full(len(first), span, np.uint64)
            for i in range(span):
                h = h * np.uint64(BASE) + words[first + i]
        return mix(h)

    whole = spans(np.arange(max(0, len(words) - width + 1)), width)
    out, at = [], 0
    for n in counts.tolist():
        if n >= width:
            out.append(np.unique(whole[at : at + n - width + 1]))
        else:
            out.append(spans(np.array([at]), n) if n else np.empty(0, np.uint64))
        at += n
    return out


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    return shingle_sets([text], width)[0]


def set_key(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def short_key(key: bytes) -> int:
    """Half of a key. Candidates are found by it; classes that had it in common would be candidates of each other."""
    return int.from_bytes(key[:8], "little", signed=True)


def _merged(hashes: np.ndarray) -> int:
    low = np.sort(hashes.astype("<u4"))
    return int(np.count_nonzero(low[1:] == low[:-1]))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("print"))


def members(docs: DataFrame, *, id_col: str, text_col: str, width: int = WIDTH) -> DataFrame:
    """One row per document: id, print (hash of the text), key and short key of its class (null if empty), n (set size),
    merged (by how many fewer its hashes are in their lower 32 bits, at most those that fall together in a bucket)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            keys, sizes, merged = [], [], []
            for _, texts in slices(batch.column(1).to_pylist()):
                for h in shingle_sets(texts, width):
                    sizes.append(len(h))
                    merged.append(_merged(h))
                    keys.append(set_key(h) if len(h) else None)
            shorts = [None if k is None else short_key(k) for k in keys]
            arrays = [pa.array(keys, pa.binary()), pa.array(shorts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(merged, pa.int64())]
            labels = ["id", "print", "key", "short", "n", "merged"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *arrays], labels)

    return _texts(docs, id_col, text_col).mapInArrow(trimmed(run), f"id {kind}, print long, key binary, short long, n long, merged long")


def _pack(shorts: np.ndarray, counts: np.ndarray, *values: np.ndarray) -> bytes:
    """Classes with their numbers of values, and the values, class by class, as one payload."""
    size = 1 if counts.max() < 256 else 4
    parts = (np.array([len(shorts), size], "<u4"), shorts.astype("<i8"), counts.astype(f"<u{size}"), *values)
    return b"".join(p.tobytes() for p in parts)


def _unpack(payloads: pa.ChunkedArray, *kinds: str):
    """The classes of many payloads: their distinct short keys, and for each value its class, then the values."""
    shorts, counts, values = [], [], [[] for _ in kinds]
    for payload in payloads:
        raw = payload.as_buffer()
        n, size = np.frombuffer(raw, "<u4", 2).tolist()
        shorts.append(np.frombuffer(raw, "<i8", n, 8))
        counts.append(np.frombuffer(raw, f"<u{size}", n, 8 + 8 * n))
        at, total = 8 + (8 + size) * n, int(counts[-1].sum())
        for kind, found in zip(kinds, values, strict=True):
            found.append(np.frombuffer(raw, kind, total, at))
            at += found[-1].nbytes
    names, own = np.unique(np.concatenate(shorts), return_inverse=True)
    return names, np.repeat(own.astype(np.int32), np.concatenate(counts)), *map(np.concatenate, values)


def _runs(sorted_values: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(sorted_values, prepend=-1, append=-1)).tolist()
    return list(zip(edges[:-1], edges[1:], strict=True)) if len(sorted_values) else []


def _bucket_keys(spark: SparkSession, hashes: int) -> np.ndarray:
    """Keys of as many buckets as so many hashes need, which Spark's hash deals evenly to the shuffle's partitions."""
    partitions = shuffle_partitions(spark)
    each = max(1, -(-hashes // (BUCKET_HASHES * partitions)))
    tried = 4 * partitions * each + 100
    while True:
        key = F.col("id").cast("int")
        rows = spark.range(tried).select(key.alias("key"), F.pmod(F.hash(key), F.lit(partitions)).alias("of")).toPandas()
        first = rows[rows.groupby("of").cumcount() < each]
        if len(first) == partitions * each:
            return np.sort(first.key.to_numpy(np.int32))
        tried *= 2


def _dealt(docs: DataFrame, *, id_col: str, text_col: str, width: int, bucket_keys: np.ndarray) -> DataFrame:
    """Hashes of each class dealt to buckets: (bucket, payload); payloads hold the lower 32 bits."""
    buckets = len(bucket_keys)

    def flush(keys: list[int], sets: list[np.ndarray]):
        every = np.concatenate(sets)
        of = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
        high = ((every >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(high, kind="stable")  # classes stay in order
        high, of, low = high[order], of[order], every[order].astype("<u4")
        del every, order
        names = np.array(keys, np.int64)
        rows, payloads = [], []
        for a, b in _runs(high):
            own, counts = np.unique(of[a:b], return_counts=True)
            payloads.append(_pack(names[own], counts, low[a:b]))
            rows.append(bucket_keys[high[a]])
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(payloads, pa.binary())], ["bucket", "payload"])

    def run(batches):
        keys, sets, size, seen = [], [], 0, set()
        for batch in batches:
            for _, texts in slices(batch.column(1).to_pylist()):
                for h in shingle_sets(texts, width):
                    if not len(h) or (key := short_key(set_key(h))) in seen:
                        continue
                    seen.add(key)
                    keys.append(key)
                    sets.append(h)
                    size += len(h)
                if size >= GATHERED:
                    yield flush(keys, sets)
                    keys, sets, size = [], [], 0
        if sets:
            yield flush(keys, sets)

    return _texts(docs, id_col, text_col).mapInArrow(trimmed(run), "bucket int, payload binary")


def _shared(bucket_keys: np.ndarray):
    """Of a bucket: the hashes that several classes have, with the number of classes, dealt to parts by class."""
    buckets = len(bucket_keys)

    def run(table: pa.Table) -> pa.Table:
        names, of, low = _unpack(table.column("payload"), "<u4")
        ranges = max(1, len(low) // GATHERED + 1)
        classes, hashes, times = [], [], []
        for part in range(ranges):  # a range of hashes at a time
            first, last = (part << 32) // ranges, ((part + 1 << 32) // ranges) - 1
            chosen = (low >= np.uint32(first)) & (low <= np.uint32(last)) if ranges > 1 else slice(None)
            pairs = np.unique(low[chosen].astype(np.uint64) << np.uint64(32) | of[chosen].astype(np.uint64))
            value = pairs >> np.uint64(32)
            starts = np.flatnonzero(np.diff(value, prepend=np.uint64(1 << 40)))
            runs = np.diff(starts, append=len(value))
            count = np.repeat(runs, runs)
            many = count > 1
            classes.append((pairs[many] & np.uint64(0xFFFFFFFF)).astype(np.int32))
            hashes.append(value[many].astype("<u4"))
            times.append(np.minimum(count[many], 0xFFFF).astype("<u2"))
        del low, of
        cls, value, count = map(np.concatenate, (classes, hashes, times))
        part = (names % buckets).astype(np.int32)
        order = np.lexsort((cls, part[cls]))
        cls, value, count = cls[order], value[order], count[order]
        rows, payloads = [], []
        for a, b in _runs(part[cls]):
            own, n = np.unique(cls[a:b], return_counts=True)
            payloads.append(_pack(names[own], n, value[a:b], count[a:b]))
            rows.append(bucket_keys[part[cls[a]]])
        bucket = table.column("bucket")[0].as_py()
        release()
        return pa.table({
            "part": pa.array(rows, pa.int32()),
            "bucket": pa.array([bucket] * len(rows), pa.int32()),
            "payload": pa.array(payloads, pa.binary()),
        })

    return run


def _lookups():
    """Of a part's classes: (token, short, low, high) of the shared shingles within each class's prefix; the size bands of
    the classes with one short key go from low to high."""

    def run(table: pa.Table, known: pa.Table) -> pa.Table:
        if not table.num_rows:
            empty = {"token": pa.int64(), "short": pa.int64(), "low": pa.int32(), "high": pa.int32()}
            return pa.table({c: pa.array([], t) for c, t in empty.items()})
        buckets = table.column("bucket").to_numpy()
        held = [_unpack(table.column("payload").slice(i, 1), "<u4", "<u2") for i in range(len(buckets))]
        names, own = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        at = np.searchsorted(known.column("short").to_numpy(), names)
        least, low_band, high_band = (known.column(c).to_numpy()[at] for c in ("least", "low", "high"))
        starts = np.cumsum([0, *(len(h[0]) for h in held)])
        cls = np.concatenate([own[a + of] for a, (_, of, _, _) in zip(starts, held, strict=False)])
        token = np.concatenate([np.int64(b) << 32 | low.astype(np.int64) for b, (_, _, low, _) in zip(buckets.tolist(), held, strict=True)])
        count = np.concatenate([h[3] for h in held])
        shared = np.bincount(cls, minlength=len(names))
        wanted = shared - least + 1  # what the prefix has besides shingles of this class alone
        near = wanted[cls] > 0
        cls, token, count = cls[near], token[near], count[near]
        order = np.lexsort((token, count, cls))
        cls, token = cls[order], token[order]
        first = np.arange(len(cls)) - np.searchsorted(cls, cls) < wanted[cls]
        cls = cls[first]
        return pa.table({
            "token": pa.array(token[first]), "short": pa.array(names[cls]), "low": pa.array(low_band[cls]), "high": pa.array(high_band[cls]),
        })

    def sorted_known(table: pa.Table, known: pa.Table) -> pa.Table:
        return run(table, known.sort_by("short"))

    return sorted_known


def _meetings(lookups: DataFrame) -> DataFrame:
    """(short, hub): edges that connect the classes that meet on a token, as far as their sizes are in equal or adjacent bands.

    Per token and band the least class is the hub; classes of one band are joined with it, and hubs of adjacent bands.
    """
    placed = lookups.select("token", "short", F.explode(F.sequence("low", "high")).alias("band"))
    hubs = placed.groupBy("token", "band").agg(F.min("short").alias("hub"), F.count(F.lit(1)).alias("times"))
    same = placed.join(hubs.where("times > 1"), ["token", "band"]).select("short", "hub")
    above = hubs.select("token", (F.col("band") - 1).alias("band"), F.col("hub").alias("short"))
    return same.unionByName(hubs.join(above, ["token", "band"]).select("short", "hub"))


def _band(n: Column, percent: int) -> Column:
    """Bands whose sizes grow by 100 / percent: sets that link lie in equal or adjacent ones."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(100 / percent)) + 1e-9).cast("int")


#: Tiles of a class's own band and the adjacent ones: {of} names a tile of a band and a salt.
_AROUND = """flatten(transform(filter(array(band - 1, band, band + 1), b -> map_contains_key(salts, b)),
    b -> transform(sequence(0, salts[b] - 1), s -> {of})))"""


def _chunks(scratch: Scratch, comps: DataFrame, percent: int) -> DataFrame:
    """Adds to (key, n, root, ...): band, salts (of the component's bands), salt and small (one tile holds all)."""
    banded = comps.withColumn("band", _band(F.col("n"), percent))
    bands = banded.groupBy("root", "band").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("hashes"))
    salts = F.greatest(F.ceil(F.col("sets") / TILE_SETS), F.ceil(F.col("hashes") / TILE_HASHES)).cast("int")
    whole = bands.groupBy("root").agg(
        F.map_from_entries(F.collect_list(F.struct("band", salts.alias("salts")))).alias("salts"),
        F.sum("sets").alias("sets"),
        F.sum("hashes").alias("hashes"),
    )
    whole = whole.withColumn("small", (F.col("sets") <= TILE_SETS) & (F.col("hashes") <= TILE_HASHES))
    joined = banded.join(whole, "root").withColumn("salt", F.expr("cast(pmod(xxhash64(key), salts[band]) as int)"))
    return scratch.table(joined, "chunks")


def _own_tiles(chunks: DataFrame) -> DataFrame:
    """Each class in the tile of its chunk; a small component is in one tile, which it shares with others.

    One class of each band of a large component stands in all tiles of its own and the adjacent bands, so that what is
    like it is connected across tiles.
    """
    total = chunks.where("small").agg(F.sum("n")).first()[0] or 0
    groups = max(1, -(-int(total) // (TILE_HASHES // 4)))
    small = chunks.where("small").withColumn("tiles", F.expr(f"array(concat('s', pmod(xxhash64(root), {groups})))"))
    large = chunks.where("NOT small")
    heads = large.groupBy("root", "band").agg(F.min("key").alias("head"))
    every = F.expr(_AROUND.format(of="concat_ws(':', root, b, s)"))
    tiles = F.when(F.col("key") == F.col("head"), every).otherwise(F.array(F.concat_ws(":", "root", "band", "salt")))
    large = large.join(heads, ["root", "band"]).withColumn("tiles", tiles).drop("head")
    return small.unionByName(large).withColumn("side", F.lit(""))


def _cross_tiles(scratch: Scratch, chunks: DataFrame, linked: DataFrame) -> DataFrame | None:
    """What is left to compare in large components: classes outside the largest known part of theirs, with all others.

    Such a class visits the chunks of its own and the adjacent bands but its own one, where it has been compared; visitors
    that are many come in groups. None if there are no such classes.
    """
    large = chunks.where("NOT small").join(linked.select(F.col("node").alias("key"), F.col("root").alias("part")), "key", "left")
    large = large.withColumn("part", F.coalesce("part", "key"))
    parts = large.groupBy("root", "part").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("hashes"))
    main = parts.groupBy("root").agg(
        F.max(F.struct("sets", "part")).alias("main"), F.sum("sets").alias("all_sets"), F.sum("hashes").alias("all_hashes"),
        F.max_by("hashes", F.struct("sets", "part")).alias("main_hashes"),
    )
    rest = F.greatest(
        F.ceil((F.col("all_sets") - F.col("main.sets")) / TILE_SETS), F.ceil((F.col("all_hashes") - F.col("main_hashes")) / TILE_HASHES)
    )
    main = main.select("root", F.col("main.part").alias("main"), rest.cast("int").alias("groups")).where("groups > 0")
    main = scratch.table(main, "main")
    if main.isEmpty():
        return None
    left = large.join(main, "root")
    home = F.expr("transform(sequence(0, groups - 1), g -> concat_ws(':', root, band, salt, g))")
    members = left.withColumn("tiles", home).withColumn("side", F.lit("home"))
    visits = F.expr("filter(" + _AROUND.format(of="struct(b AS band, s AS salt)") + ", t -> t.band <> band OR t.salt <> salt)")
    named = "transform(visits, t -> concat_ws(':', root, t.band, t.salt, pmod(xxhash64(key, 1), groups)))"
    visitors = left.where("part <> main").withColumn("visits", visits).withColumn("tiles", F.expr(named))
    visitors = visitors.where("size(tiles) > 0").withColumn("side", F.lit("visitor")).drop("visits")
    return members.unionByName(visitors).drop("main", "groups", "part")


def settle(sets: list[np.ndarray], sides: list[str], percent: int) -> list[int]:
    """Labels of sets (sorted arrays): equal for sets that links within the tile connect.

    If the sets are of two sides, only pairs with a visitor are looked at.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    sets, sizes = [sets[i] for i in order], sizes[order]
    visitor = np.array([sides[i] == "visitor" for i in order])
    across = any(sides)
    width = 64
    while width < 2 * sizes[-1]:
        width *= 2
    signatures = np.zeros((m, width // 64), np.uint64)
    for row, s in zip(signatures, sets, strict=True):
        bits = np.zeros(width, np.uint8)
        bits[s & np.uint64(width - 1)] = 1
        row[:] = np.packbits(bits).view(np.uint64)
    label = np.arange(m)
    left = m
    for i in range(m - 1):
        end = int(np.searchsorted(sizes, sizes[i] * 100 // percent, "right"))
        others = np.arange(i + 1, max(i + 1, end))
        others = others[label[others] != label[i]]
        if across and not visitor[i]:
            others = others[visitor[others]]
        if not len(others):
            continue
        differ = np.bitwise_count(signatures[others] ^ signatures[i]).sum(axis=1, dtype=np.int64)
        both = sizes[others] + sizes[i]
        # overlap <= (both - differ) / 2, and a link needs 100 * overlap >= percent * (both - overlap)
        for j in others[(100 + percent) * (both - differ) >= 2 * percent * both]:
            if label[j] == label[i]:
                continue
            at = np.searchsorted(sets[j], sets[i])
            at[at == sizes[j]] = 0
            overlap = int((sets[j][at] == sets[i]).sum())
            if 100 * overlap >= percent * (sizes[i] + sizes[j] - overlap):
                label[label == label[j]] = label[i]
                left -= 1
        if left == 1:
            break
    out = np.empty(m, np.int64)
    out[order] = label
    return out.tolist()


def _linked(percent: int):
    def run(table: pa.Table) -> pa.Table:
        groups: dict[int, dict[bytes, tuple[np.ndarray, str]]] = {}
        for root, key, side, raw in zip(*(table.column(c) for c in ("root", "key", "side", "hashes")), strict=True):
            groups.setdefault(root.as_py(), {}).setdefault(
                key.as_py(), (np.frombuffer(raw.as_buffer(), "<u8"), side.as_py())
            )
        a, b = [], []
        for found in groups.values():
            keys = list(found)
            if all(side == "home" for _, side in found.values()):
                continue
            first: dict[int, bytes] = {}
            for key, label in zip(keys, settle(*map(list, zip(*found.values(), strict=True)), percent), strict=True):
                if first.setdefault(label, key) != key:
                    a.append(first[label])
                    b.append(key)
        release()
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return run


def _few(frame: DataFrame) -> DataFrame:
    return F.broadcast(frame) if frame.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else frame


def _sets(docs: DataFrame, wanted: DataFrame, *, id_col: str, text_col: str, width: int) -> DataFrame:
    """Rows (tile, root, key, side, hashes) of the wanted classes, from the text of one document of each."""
    texts = _texts(docs, id_col, text_col)
    # one document of a class by print and identifier: its copies are left out
    chosen = texts.join(
        _few(wanted.withColumnRenamed("print", "_print").withColumnRenamed("id", "_id")),
        (F.col("print") == F.col("_print")) & F.col("id").eqNullSafe(F.col("_id")),
    )
    small = chosen.select("text", "key", "root", "side", "tiles")

    def run(batches):
        for batch in batches:
            parts = slices(batch.column(0).to_pylist())
            hashes = pa.array([h.tobytes() for _, texts in parts for h in shingle_sets(texts, width)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], hashes], ["key", "root", "side", "tiles", "hashes"])

    done = small.mapInArrow(trimmed(run), "key binary, root long, side string, tiles array<string>, hashes binary")
    return done.select("root", "key", "side", "hashes", F.explode("tiles").alias("tile"))


def _compare(scratch: Scratch, docs: DataFrame, tiles: DataFrame, percent: int, **names) -> DataFrame:
    """(a, b): links found in the tiles, as many as connect what links there connect."""
    wanted = scratch.table(tiles.select("key", "root", "side", "tiles", "one.print", "one.id"), "tiles")
    sets = _sets(docs, wanted, **names)
    links = scratch.table(sets.groupBy("tile").applyInArrow(_linked(percent), "a binary, b binary"), "links")
    scratch.drop("tiles")
    return links


def link(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT
) -> DataFrame:
    """One row per document: id, print, n_shingles, class key and component_id (smallest identifier reachable)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram")
    names = {"id_col": id_col, "text_col": text_col, "width": width}
    rows = scratch.table(members(docs, **names), "members")
    classes = rows.where("n > 0").groupBy("key").agg(
        F.min("n").alias("n"), F.min("short").alias("short"), F.min(F.struct("print", "id")).alias("one")
    )

    total = classes.agg(F.sum("n")).first()[0] or 0
    bucket_keys = _bucket_keys(spark, int(total))
    dealt = _dealt(docs, **names, bucket_keys=bucket_keys)
    shared = dealt.groupBy("bucket").applyInArrow(_shared(bucket_keys), "part int, bucket int, payload binary")
    # shingles that fall together are shared as one, so that the overlap may be less by as many; of classes with one short
    # key the one with the least overlap decides, which looks up most
    least = F.min(F.expr(f"({percent} * n + 99) div 100 - merged")).alias("least")
    band = _band(F.col("n"), percent)
    sizes = rows.where("n > 0").groupBy("short").agg(least, F.min(band).alias("low"), F.max(band).alias("high"))
    parts = spark.createDataFrame(list(enumerate(bucket_keys.tolist())), "at long, part int")
    sizes = sizes.withColumn("at", F.pmod("short", F.lit(len(bucket_keys)))).join(F.broadcast(parts), "at").drop("at")
    lookups = shared.groupBy("part").cogroup(sizes.groupBy("part")).applyInArrow(_lookups(), "token long, short long, low int, high int")
    lookups = scratch.table(lookups, "lookups")

    candidates = _meetings(lookups)
    roots = connected_components(scratch, candidates, "short", "hub").select(F.col("node").alias("short"), "root")
    comps = scratch.table(roots.join(classes, "short").drop("short"), "candidates")
    scratch.drop("lookups")
    chunks = _chunks(scratch, comps, percent)
    scratch.drop("candidates")
    links = _compare(scratch, docs, _own_tiles(chunks), percent, **names)
    linked = connected_components(scratch, links, "a", "b")
    more = _cross_tiles(scratch, chunks, linked)
    if more is not None:
        links = links.unionByName(_compare(scratch, docs, more, percent, **names))
        linked = connected_components(scratch, links, "a", "b")
    linked = scratch.table(linked, "linked")

    named = rows.join(linked.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = named.where("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("least"))
    return named.join(least, "root", "left").select(
        "id", "print", F.col("n").alias("n_shingles"), "key",
        F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without those that link, directly or not, with a document of a smaller identifier."""
    scratch = Scratch(docs.sparkSession, "one")
    linked = scratch.table(link(docs, id_col=id_col, text_col=text_col, **options), "linked")
    own, print_, name = fresh(docs, "own", "print", "name")
    dropped = linked.where(~F.col("id").eqNullSafe(F.col("component_id"))).select(
        F.col("print").alias(print_), F.col("id").alias(name)
    )
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    marked = docs.withColumn(own, F.xxhash64(text))
    same = (F.col(own) == F.col(print_)) & F.col(id_col).eqNullSafe(F.col(name))
    return marked.join(_few(dropped), same, "left_anti").drop(own)
