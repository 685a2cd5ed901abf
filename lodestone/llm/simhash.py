"""SimHash near-duplicate detection by multi-index hashing.

``fingerprints`` makes one 64-bit SimHash per text. ``link_components`` joins fingerprints
that differ in few bits: each fingerprint is cut into two 32-bit segments; two fingerprints
within three bits agree up to one bit in at least one segment. Every fingerprint is entered
in a table under its segment value and looks up the ball of radius one around it; only flips
from 0 to 1 are looked up, since of two values one bit apart exactly one has the 0. Entries
that meet under a key are verified by their complete distance.

A key that very many fingerprints share is split by the other segment, again with balls of
radius one around its 16-bit halves, so that no task gets an unbounded group. Within a key
only as many links are emitted as connect its members, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.scratch import keep

RADIUS = 3
SHINGLE = 3
#: Fingerprints that share a segment value before the value is split by the other segment.
HOT_KEY = 1024
#: Near copies: the least similarity of shingle sets, and bands of minima by which they meet. A pair at 0.8 meets with a chance of 1 - (1 - 0.8 ** 5) ** 20, 0.9996.
SIMILARITY, BANDS, ROWS = 0.8, 20, 5
#: XXH64 seed of the shingle hashes.
SEED = 42


def simhash(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the 64-bit hashes; no hashes: zero."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of every run of ``size`` words joined by a space; fewer words: of the whole sequence."""
    from xxhash import xxh64_intdigest

    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= size:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())], np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): the SimHash of each whole text as a signed long.

    A-Z are lower-cased; words are runs without ASCII white space. A null or empty text has
    fingerprint zero. Repeated rows give repeated rows; null ids are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((simhash(shingle_hashes((t.as_py() or b"").lower().split(), shingle)) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return given.mapInArrow(run, "id long, fp long").select(F.col("id").alias(id_col), "fp")


def _segment(fp: Column, which: int, width: int = 32) -> Column:
    return F.shiftrightunsigned(fp, which * width).bitwiseAND((1 << width) - 1)


def _keys(value: Column, width: int) -> Column:
    """The value itself and its neighbours by one bit from 0 to 1."""
    flips = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: value.bitwiseOR(F.expr("1L").cast("long") * F.pow(F.lit(2.0), i).cast("long")))
    return F.array_union(F.array(value), flips)


def _near(x: np.ndarray, y: np.ndarray | np.uint64, radius: int) -> np.ndarray:
    return np.bitwise_count(x ^ y) <= radius


def _stars(members: np.ndarray, radius: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that connect what lies within the radius among the members of one key.

    A breadth-first walk: each member is held against those not yet reached only, so a
    dense group costs little and yields one link for each member.
    """
    left, right = [], []
    rest = np.unique(members)
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            node = queue.pop()
            hit = _near(rest, node, radius)
            if hit.any():
                found = rest[hit]
                left.append(np.full(len(found), node, np.uint64))
                right.append(found)
                queue.extend(found)
                rest = rest[~hit]
    return left, right


def _verified_links(entries: DataFrame, radius: int) -> DataFrame:
    """(u, v) links among the fingerprints of each (table, key); entries are dealt by key and sorted."""

    def links_of(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch | None:
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sizes = np.diff(np.concatenate((starts, [len(keys)])))
        two = starts[sizes == 2]
        ok = _near(fps[two], fps[two + 1], radius) & (fps[two] != fps[two + 1]) if len(two) else np.zeros(0, bool)
        left, right = [fps[two][ok]], [fps[two + 1][ok]]
        for at, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            a, b = _stars(fps[at : at + n], radius)
            left += a
            right += b
        u, v = np.concatenate(left), np.concatenate(right)
        if not len(u):
            return None
        pairs = np.unique(np.stack((np.minimum(u.view(np.int64), v.view(np.int64)), np.maximum(u.view(np.int64), v.view(np.int64))), 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.concatenate((keys, batch.column(0).to_numpy(zero_copy_only=False)))
            fps = np.concatenate((fps, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            last = int(np.searchsorted(keys, keys[-1])) if keys[0] != keys[-1] else 0  # the last key may go on in the next batch
            if last and (out := links_of(keys[:last], fps[:last])) is not None:
                yield out
            keys, fps = keys[last:], fps[last:]
        if len(keys) and (out := links_of(keys, fps)) is not None:
            yield out

    # One signed long orders a key: two keys that collide in it only add verified comparisons.
    return entries.select("key", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(run, "u long, v long").distinct()


def links(fps: DataFrame, radius: int = RADIUS, hot_key: int = HOT_KEY) -> DataFrame:
    """(u, v) with u < v: links that connect all distinct fingerprints within ``radius`` (3 at most) bits.

    ``fps`` has one row for each distinct ``fp``. Every component of the full link graph is
    connected by the rows returned; links inside it that are not needed for that are left out.
    """
    if radius > 3:
        raise ValueError("two segments with balls of radius one guarantee three bits at most")
    segments = fps.select("fp", F.explode(F.array(F.lit(0), F.lit(1))).alias("s"))
    segments = segments.withColumn("value", F.when(F.col("s") == 0, _segment(F.col("fp"), 0)).otherwise(_segment(F.col("fp"), 1)))
    hot = segments.groupBy("s", "value").count().where(F.col("count") > hot_key)
    around = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.col("value").bitwiseXOR(F.pow(F.lit(2.0), i).cast("long")))
    # Written, so that the planner knows its size: broadcast if small, else a shuffled join.
    hot = keep(hot.select("s", F.explode(F.concat(F.array("value"), around)).alias("at")).distinct(), "simhash-hot").withColumn("is_hot", F.lit(True))
    entries = segments.select("fp", "s", F.explode(_keys(F.col("value"), 32)).alias("at")).join(hot, ["s", "at"], "left")
    plain = entries.where("is_hot is null").select("fp", F.xxhash64("s", "at").alias("key"))
    other = F.when(F.col("s") == 0, _segment(F.col("fp"), 1)).otherwise(_segment(F.col("fp"), 0))
    split = entries.where("is_hot").select("fp", "s", "at", other.alias("other"))
    halves = [split.select("fp", F.explode(_keys(_segment(F.col("other"), h, 16), 16)).alias("half"), "s", "at").select("fp", F.xxhash64("s", "at", F.lit(h), "half").alias("key")) for h in (0, 1)]
    return _verified_links(plain.unionByName(halves[0]).unionByName(halves[1]), radius)


def components(edges: DataFrame, nodes_bound: int = 64) -> DataFrame:
    """(node, root): the smallest node that each linked node reaches.

    Rounds of contraction: every node points to the smallest node next to it, pointers are
    followed to their ends, and links are rewritten between the ends. Each round at least
    halves the nodes that still have links; nothing is collected.
    """
    edges = keep(edges.select("u", "v"), "cc-edges")
    labels: DataFrame | None = None
    for _ in range(nodes_bound):
        if edges.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        point = keep(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("to")), "cc-point")
        while True:
            end = point.select(F.col("node").alias("to"), F.col("to").alias("end"))
            jumped = keep(point.join(end, "to").select("node", "to", "end"), "cc-jump")
            point = jumped.select("node", F.col("end").alias("to"))
            if jumped.where("`to` <> `end`").isEmpty():
                break
        if labels is None:
            labels = point.select("node", F.col("to").alias("root"))
        else:
            labels = keep(labels.join(point.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "cc-labels")
        a, b = point.select(F.col("node").alias("u"), F.col("to").alias("u2")), point.select(F.col("node").alias("v"), F.col("to").alias("v2"))
        edges = keep(edges.join(a, "u").join(b, "v").where("u2 <> v2").select(F.least("u2", "v2").alias("u"), F.greatest("u2", "v2").alias("v")).distinct(), "cc-edges")
    return labels if labels is not None else edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(id, fp, component_id): the component of each document under links of ``radius`` bits or fewer.

    ``component_id`` is the smallest id reachable, the document's own included; null only
    where all ids reachable are null. An empty table gives an empty result.
    """
    marked = keep(fingerprints(docs, id_col, text_col, shingle).withColumnRenamed(id_col, "id"), "simhash-fp")
    classes = keep(marked.groupBy("fp").agg(F.min("id").alias("rep")), "simhash-classes")
    roots = components(links(classes.select("fp"), radius))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = keep(rooted.join(least, "root").select("fp", "component_id"), "simhash-named")
    return marked.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def set_digest(members: np.ndarray) -> bytes:
    """Names a set of shingle hashes, given sorted and without repeats."""
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(members.tobytes())


def shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    return np.unique(shingle_hashes((text or b"").lower().split(), shingle))


def band_keys(members: np.ndarray, bands: int, rows: int) -> list[int]:
    """One signed key for each band of ``rows`` minima over the set; none for an empty set."""
    from xxhash import xxh64_digest

    if not len(members):
        return []
    rng = np.random.default_rng(SEED)
    flip, factor = rng.integers(0, 1 << 64, (2, bands * rows), np.uint64)
    factor |= np.uint64(1)
    least = np.min([((members[at : at + 512, None] ^ flip) * factor).min(axis=0) for at in range(0, len(members), 512)], axis=0)
    return [int.from_bytes(xxh64_digest(least[k * rows : (k + 1) * rows].tobytes(), k), "big", signed=True) for k in range(bands)]


def set_keys(docs: DataFrame, id_col: str, text_col: str, shingle: int, bands: int, rows: int) -> DataFrame:
    """(id, d, fp, keys): the digest of each whole text's shingle set, its SimHash and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, fps, keys = [], np.zeros(batch.num_rows, np.uint64), []
            for i, t in enumerate(batch.column(1)):
                hashes = shingle_hashes((t.as_py() or b"").lower().split(), shingle)
                members = np.unique(hashes)
                digests.append(set_digest(members))
                fps[i] = simhash(hashes)
                keys.append(band_keys(members, bands, rows))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(fps.view(np.int64)), pa.array(keys, pa.list_(pa.int64()))], names=["id", "d", "fp", "keys"])

    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return given.mapInArrow(run, "id long, d binary, fp long, keys array<long>")


def fingerprint_pairs(classes: DataFrame) -> DataFrame:
    """(u, v) ids of (rep, fp) that ``links`` joins by their fingerprints, and those that share one."""
    heads = keep(classes.groupBy("fp").agg(F.min("rep").alias("head")), "near-fps")
    side = lambda n: heads.select(F.col("fp").alias(n), F.col("head").alias(f"h{n}"))
    apart = links(heads.select("fp")).join(side("u"), "u").join(side("v"), "v").select(F.col("hu").alias("u"), F.col("hv").alias("v"))
    alike = classes.join(heads, "fp").where("rep <> head").select(F.col("head").alias("u"), F.col("rep").alias("v"))
    return apart.unionByName(alike).where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def _similar_pairs(pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(u, v) of those rows (u, v, tu, tv) whose texts have the similarity, by their whole shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, head = None, np.zeros(0, np.uint64)  # many pairs share a head
        for batch in batches:
            keep_row = []
            for a, b in zip(batch.column(2), batch.column(3)):
                if (text := a.as_py()) != last:
                    last, head = text, shingle_set(text, shingle)
                other = shingle_set(b.as_py(), shingle)
                both = len(np.intersect1d(head, other, assume_unique=True))
                keep_row.append(both >= similarity * (len(head) + len(other) - both))
            yield batch.select([0, 1]).filter(pa.array(keep_row, pa.bool_()))

    return pairs.select("u", "v", "tu", "tv").mapInArrow(run, "u long, v long")


def _links_in_cell(ids: np.ndarray, roots: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that join whatever is similar among members of different roots; all such pairs are held against each other unless a link already joins them."""
    names, group = np.unique(roots, return_inverse=True)
    sizes = np.bincount(group)
    lengths = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), lengths)
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(lengths)))
    label, out = group.copy(), []
    mark = np.zeros(codes.max() + 1 if len(codes) else 0, bool)
    for x in np.flatnonzero(group != sizes.argmax()):  # a pair across roots has a member outside the largest
        if (label == label[x]).all():
            break
        own = codes[starts[x] : starts[x + 1]]
        mark[own] = True
        both = np.bincount(owner[mark[codes]], minlength=len(sets))
        mark[own] = False
        hit = (both >= similarity * (lengths + lengths[x] - both)) & (label != label[x])
        for other in np.unique(label[hit]).tolist():
            y = int(np.flatnonzero(hit & (label == other))[0])
            out.append((int(min(ids[x], ids[y])), int(max(ids[x], ids[y]))))
            label[label == other] = label[x]
    return out


def _similar_in_cells(rows: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(u, v) links of each cell of rows (cell, id, root, text)."""

    def links_of(ids: list, roots: list, texts: list) -> list[tuple[int, int]]:
        return _links_in_cell(np.array(ids), np.array(roots), [shingle_set(t, shingle) for t in texts], similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, ([], [], [])
        for batch in batches:
            found = []
            for now, *row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if now != cell and held[0]:
                    found += links_of(*held)
                    held = ([], [], [])
                cell = now
                for column, x in zip(held, row):
                    column.append(x)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.int64()), pa.array([v for _, v in found], pa.int64())], names=["u", "v"])
        if held[0] and (found := links_of(*held)):
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.int64()), pa.array([v for _, v in found], pa.int64())], names=["u", "v"])

    return rows.select("cell", "id", "root", "text").repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "u long, v long").distinct()


def _cells(entries: DataFrame, hot_key: int) -> DataFrame:
    """(cell, id, root) for (key, id, root): every two members of a key with different roots meet in a cell.

    The largest root's members are dealt into chunks and all others into blocks of about
    ``hot_key``; every block meets every chunk and every other block, so no task gets an
    unbounded group and members that are linked already aren't sent to meet each other.
    """
    by_root = entries.groupBy("key", "root").count()
    most = keep(by_root.groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.max("count").alias("n_main"), F.sum("count").alias("n"), F.count(F.lit(1)).alias("roots")).where("roots > 1"), "near-open")
    parts = lambda n: F.greatest(F.lit(1), F.ceil(n / F.lit(hot_key))).cast("int")
    dealt = entries.join(most, "key").select("key", "id", "root", (F.col("root") == F.col("main")).alias("inner"), parts(F.col("n_main")).alias("chunks"), parts(F.col("n") - F.col("n_main")).alias("blocks"))
    own = F.pmod(F.xxhash64("id"), F.when(F.col("inner"), F.col("chunks")).otherwise(F.col("blocks"))).cast("int")
    cell = lambda kind, a, b: F.xxhash64("key", F.lit(kind), a, b)
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    to_blocks = F.transform(upto("blocks"), lambda i: cell(0, i, F.col("own")))
    to_chunks = F.transform(upto("chunks"), lambda j: cell(0, F.col("own"), j))
    to_others = F.when(F.col("blocks") > 1, F.transform(upto("blocks"), lambda j: cell(1, F.least(F.col("own"), j), F.greatest(F.col("own"), j)))).otherwise(F.array().cast("array<long>"))
    sent = F.when(F.col("inner"), to_blocks).otherwise(F.concat(to_chunks, to_others))
    return dealt.withColumn("own", own).select(F.explode(sent).alias("cell"), "id", "root")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, hot_key: int = HOT_KEY) -> DataFrame:
    """(node, root): ids of texts with near copies, and the smallest id that each reaches.

    Near copies are texts whose sets of shingles have the similarity (size of the
    intersection over that of the union), always computed on the whole sets. Texts whose
    fingerprints ``links`` joins are candidates, and so that none is lost to more than
    ``RADIUS`` bits, also those that agree in the minima of one band. Each of these is first
    held against the head of each key; keys that then still hold members without a chain of verified links between
    them are gone through member by member, so no link is left out for one that fails.
    Texts with the same id count as one document; rows without id are left out.
    """
    named = docs.where(F.col(id_col).isNotNull())
    written = keep(set_keys(named, id_col, text_col, shingle, bands, rows), "near-keys")
    # A class is one set of shingles; it goes by its smallest id, which may have other texts too.
    classes = keep(written.groupBy("d").agg(F.min("id").alias("rep"), F.min("fp").alias("fp"), F.first("keys").alias("keys")), "near-classes")
    copies = written.join(classes.select("d", "rep"), "d").where("id <> rep").select(F.col("rep").alias("u"), F.col("id").alias("v"))
    entries = classes.select("rep", F.explode("keys").alias("key")).distinct()
    # Keys with the same members count once: near copies mostly share many.
    met = entries.groupBy("key").agg(F.min("rep").alias("head"), F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("rep")).alias("sum")).where("n > 1")
    groups = keep(met.groupBy("head", "n", "sum").agg(F.min("key").alias("key")).select("key", "head"), "near-groups")
    shared = keep(entries.join(groups, "key").select("key", "head", F.col("rep").alias("id")), "near-entries")
    given = named.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    close = fingerprint_pairs(classes.select("rep", "fp"))
    pairs = keep(close.unionByName(shared.where("head <> id").select(F.col("head").alias("u"), F.col("id").alias("v"))).distinct(), "near-pairs")
    met = shared.select("id").unionByName(pairs.select(F.explode(F.array("u", "v")).alias("id"))).distinct()
    texts = keep(given.join(met, "id", "left_semi").distinct(), "near-texts")
    side = lambda n: texts.select(F.col("id").alias(n), F.col("text").alias(f"t{n}"))
    near = _similar_pairs(pairs.join(side("v"), "v").join(side("u"), "u"), shingle, similarity)
    sure = keep(near.unionByName(copies).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "near-links")
    roots = components(sure)
    rooted = shared.select("key", "id").join(roots.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    cells = keep(_cells(keep(rooted, "near-rooted"), hot_key), "near-cells")
    more = keep(_similar_in_cells(cells.join(texts, "id"), shingle, similarity), "near-more")
    return roots if more.isEmpty() else components(sure.unionByName(more))


def one_of_each_id(docs: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``docs`` whose id no other row has, and of those that repeat an id the least as JSON; null ids are left out."""
    named = docs.where(F.col(id_col).isNotNull())
    twice = keep(named.groupBy(F.col(id_col).alias("__twice")).count().where("count > 1").select("__twice"), "repeated-ids")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = named.select(F.col(id_col).alias("__id"), whole.alias("__row"))
    single = rows.join(twice, F.col("__id") == F.col("__twice"), "left_anti")
    again = rows.join(twice, F.col("__id") == F.col("__twice"), "left_semi").groupBy("__id").agg(F.min_by("__row", F.to_json("__row")).alias("__row"))
    return single.unionByName(again).select("__row.*")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the one with the smallest id stays.

    Rows without id can't be named and are kept as they are. Of rows that repeat an id the
    least one, written as JSON, stays. All columns of ``docs`` are kept, whatever their names;
    an empty table stays empty, and texts without words, null ones too, are copies of one another.
    """
    gone = keep(near_copies(docs, id_col, text_col, shingle).where("node <> root").select(F.col("node").alias("__node")), "simhash-gone")
    kept = one_of_each_id(docs, id_col)
    rows = kept.select(F.col(id_col).cast("long").alias("__id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    left = rows.join(gone, F.col("__id") == F.col("__node"), "left_anti").select("__row.*")
    return left.unionByName(docs.where(F.col(id_col).isNull()))
