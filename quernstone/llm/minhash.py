"""Near-duplicate documents: MinHash, banding, verification and connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from . import grams
from .common import cut, map_text
from .components import connected_components

#: 25 bands of 5 minima: two sets of similarity 0.85 miss each other in every band with
#: probability (1 - 0.85**5)**25 < 5e-7, sets of similarity 0.8 with 5e-5.
BANDS, ROWS = 25, 5
#: Ranges of hashes in a sketch.
BIN_BITS = 11
BINS = 1 << BIN_BITS
#: Hash ranges of ids by which documents without a candidate pair are left out.
SIEVE = 1 << 19
#: Members of a bucket that one step compares with as many others.
BLOCK = 512


def text_shingles(texts: list[bytes | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, back to back, and where each text's begin.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. A text of fewer than ``k``
    words has its whole sequence as its one shingle; without words it has none.
    """
    w = grams.words(texts, "space")
    runs = grams.shingles(w.hash, k)
    sets = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= k:
            sets.append(np.unique(runs[a : b - k + 1]))
        elif b > a:
            sets.append(grams.shingles(w.hash[a:b], b - a))
        else:
            sets.append(np.empty(0, np.uint64))
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return (np.concatenate(sets) if sets else np.empty(0, np.uint64)), at


def _hash_family(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(seed))
    return rng.integers(0, 2**32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32)


_SIGNED = StructType(
    [
        StructField("n_shingles", LongType()),
        StructField("s1", LongType()),
        StructField("s2", LongType()),
        StructField("bands", ArrayType(LongType())),
        StructField("sketch", BinaryType()),
    ]
)


def _band_keys(least: np.ndarray, bands: int, rows: int, seed: int) -> np.ndarray:
    """A 64-bit key of each band's minima and its place."""
    rng = np.random.Generator(np.random.PCG64(seed + 1))
    mul = rng.integers(0, 2**63, (bands, rows), dtype=np.uint64) | np.uint64(1)
    total = (least.reshape(-1, bands, rows).astype(np.uint64) * mul).sum(axis=2, dtype=np.uint64)
    return grams.mix(total + np.arange(1, bands + 1, dtype=np.uint64))


def sketches(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each set a byte of the smallest hash in each of ``BINS`` ranges of hashes; 0 where a range is empty."""
    out = np.zeros((len(at) - 1, BINS), np.uint8)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    place = owner * BINS + (x >> np.uint64(64 - BIN_BITS)).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))  # sets are sorted, so a range's smallest comes first
    out.ravel()[place[first]] = 1 + ((x[first] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(255)
    return out


def signatures(df: DataFrame, id_col: str, text_col: str, k: int, bands: int = BANDS, rows: int = ROWS, seed: int = 1) -> DataFrame:
    """Set size, a 128-bit digest of the shingle set, band keys of ``bands * rows`` universal hash minima, and a sketch.

    Returns ``doc_id, n_shingles, s1, s2, bands, sketch``; the last two are null for a text without words.
    """
    n = bands * rows

    def factory():
        mul, add = _hash_family(n, seed)

        def work(column: pa.Array) -> list[pa.Array]:
            x, at = text_shingles(column.cast(pa.binary()).to_pylist(), k)
            size = np.diff(at)
            full = np.flatnonzero(size)
            sums = np.zeros((2, len(size)), np.uint64)
            least = np.empty((len(full), n), np.uint32)
            if len(x):
                for i, salt in enumerate((0x51ED270B0A1F39C1, 0x2545F4914F6CDD1D)):
                    sums[i, full] = np.add.reduceat(grams.mix(x ^ np.uint64(salt)), at[:-1][full])
                short, starts = (x >> np.uint64(32)).astype(np.uint32), at[:-1][full]
                for i in range(n):
                    least[:, i] = np.minimum.reduceat(short * mul[i] + add[i], starts)
            keys = _band_keys(least, bands, rows, seed).view(np.int64)
            made = pack_sketches(sketches(x, at))
            held: list[list | None] = [None] * len(size)
            sketch: list[bytes | None] = [None] * len(size)
            for i, d in enumerate(full.tolist()):
                held[d], sketch[d] = keys[i], made[d]
            return [pa.array(size, pa.int64()), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.array(held, pa.list_(pa.int64())), pa.array(sketch, pa.binary())]

        return work

    rows_in = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_text(rows_in, "text", _SIGNED, factory, keep=["doc_id"])


def _among(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Leave out most documents that are in no pair, before their texts are shuffled.

    What is broadcast are the occupied ones of ``SIEVE`` hash ranges of ids: that many integers at most,
    however many pairs there are. A document that passes by chance is dropped by the joins that follow.
    """
    used = pairs.select(_spot(F.col("u")).alias("spot")).unionByName(pairs.select(_spot(F.col("v")).alias("spot"))).distinct()
    return docs.withColumn("spot", _spot(F.col("doc_id"))).join(F.broadcast(used), "spot", "left_semi").drop("spot")


def _verify(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Keep the pairs ``u, v`` whose full shingle sets are similar enough: 100 |A and B| >= percent |A or B|."""
    texts = _among(docs.select("doc_id", "text"), pairs)
    joined = pairs.join(texts.select(F.col("doc_id").alias("v"), F.col("text").alias("tv")), "v")
    joined = joined.join(texts.select(F.col("doc_id").alias("u"), F.col("text").alias("tu")), "u").select("u", "v", "tu", "tv")

    def check(batches):
        last: tuple[object, np.ndarray] = (None, np.empty(0, np.uint64))
        for batch in batches:
            us, tus, tvs = (batch.column(i) for i in (0, 2, 3))
            good = []
            for i in range(batch.num_rows):
                u = us[i].as_py()
                if last[0] != u:
                    last = (u, text_shingles([tus[i].as_py().encode()], k)[0])
                b = text_shingles([tvs[i].as_py().encode()], k)[0]
                both = len(np.intersect1d(last[1], b, assume_unique=True))
                good.append(100 * both >= percent * (len(last[1]) + len(b) - both))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return joined.mapInArrow(check, pairs.select("u", "v").schema)


def pack_sketches(dense: np.ndarray) -> list[bytes]:
    """A sketch in short: a bit for each range that is filled, then the bytes of those."""
    filled = dense != 0
    masks = np.packbits(filled, axis=1)
    ends = np.cumsum(filled.sum(axis=1))
    held = dense[filled].tobytes()
    return [m.tobytes() + held[a:b] for m, a, b in zip(masks, [0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def unpack_sketches(packed: list[bytes]) -> np.ndarray:
    """The dense form: one row of ``BINS`` bytes each."""
    n = BINS // 8
    filled = np.unpackbits(np.frombuffer(b"".join(p[:n] for p in packed), np.uint8)).reshape(-1, BINS).view(bool)
    dense = np.zeros(filled.shape, np.uint8)
    dense[filled] = np.frombuffer(b"".join(p[n:] for p in packed), np.uint8)
    return dense


def _alike(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, least: float) -> np.ndarray:
    """Whether sketches, row by row, may belong to sets of similarity ``least`` or more.

    The share of equal bytes among the ranges that either fills estimates the similarity. Its variance at ``least``
    is that of a sample without replacement: ``least (1 - least) (1 / filled - 1 / union)``. Five standard deviations
    and one range are allowed. Bytes are summed eight at a time in lanes that can't overflow.
    """
    lanes = lambda m: m.view(np.uint64).reshape(len(m), -1, 128).sum(axis=2, dtype=np.uint64).view(np.uint8).sum(axis=1, dtype=np.int64)
    either = lanes((x | y) != 0)
    same = lanes(x == y) - (BINS - either)
    union = (nx + ny) / (1 + least)
    spread_ = np.sqrt(least * (1 - least) * np.maximum(0, 1 / either - 1 / np.maximum(union, either)))
    return same / either >= least - 5 * spread_ - 1 / either


def _compare(x: dict, y: dict, bucket: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs between two blocks of a bucket, by index, that look similar and share no earlier bucket."""
    ok = (x["component"][:, None] != y["component"]) & (~x["minor"][:, None] | (x["rep"][:, None] < y["rep"]))
    ok &= 100 * np.minimum(x["n"][:, None], y["n"]) >= percent * np.maximum(x["n"][:, None], y["n"])
    i, j = np.nonzero(ok)
    kept = []
    for a in range(0, len(i), 16_384):
        p, q = i[a : a + 16_384], j[a : a + 16_384]
        first = (x["bands"][p] == y["bands"][q]).argmax(axis=1)
        mine = x["bands"][p, first] == bucket
        p, q = p[mine], q[mine]
        for c in range(0, len(p), 2048):
            u, v = p[c : c + 2048], q[c : c + 2048]
            good = _alike(x["sketch"][u], y["sketch"][v], x["n"][u], y["n"][v], percent / 100)
            kept.append((u[good], v[good]))
    if not kept:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*kept, strict=True))


_MEMBER = ["bucket", "a", "b", "side", "minor", "rep", "n", "component", "bands", "sketch"]


def _cross_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of a bucket's members that are in different components so far and look similar.

    ``members``: ``bucket, rep, n, component, bands, sketch``, and of each bucket ``major``, its largest component, and
    ``na`` and ``nb``, the blocks into which all its members and those outside ``major`` are cut. Each block of the
    latter meets each block of all, so no task holds more than two blocks of a bucket and every
    such pair is compared. The looks: set sizes that allow the similarity, and sketches that
    do. A pair that shares several buckets is given by the first one only.
    """
    m = members.withColumn("minor", F.col("component") != F.col("major"))
    spot = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = m.withColumn("side", F.lit(0)).withColumn("a", spot("na")).withColumn("b", upto("nb"))
    right = m.filter("minor").withColumn("side", F.lit(1)).withColumn("a", upto("na")).withColumn("b", spot("nb"))
    both = left.select(*_MEMBER).unionByName(right.select(*_MEMBER))
    both = both.repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b", "side")

    def run(batches):
        held: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            key = np.stack([held.column(c).to_numpy() for c in ("bucket", "a", "b")])
            starts = np.flatnonzero((np.diff(key, axis=1) != 0).any(axis=0)) + 1
            if len(starts):  # the last run may go on in the next batch
                yield from pairs_of(held.slice(0, int(starts[-1])), [0, *starts.tolist()], key[0])
                held = held.slice(int(starts[-1]))
        if held is not None and len(held):
            yield from pairs_of(held, [0, len(held)], held.column("bucket").to_numpy())

    def pairs_of(t: pa.Table, bounds: list[int], buckets: np.ndarray):
        t = t.combine_chunks()
        col = {c: t.column(c).to_numpy() for c in ("side", "minor", "rep", "n", "component")}
        col["bands"] = t.column("bands").combine_chunks().flatten().to_numpy().reshape(len(t), -1)
        packed = t.column("sketch").to_pylist()
        us, vs = [], []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            mid = a + int(np.searchsorted(col["side"][a:b], 1))
            if a == mid or mid == b:
                continue
            x, y = ({c: v[s] for c, v in col.items()} | {"sketch": unpack_sketches(packed[s])} for s in (slice(a, mid), slice(mid, b)))
            i, j = _compare(x, y, int(buckets[a]), percent)
            us.append(np.minimum(x["rep"][i], y["rep"][j]))
            vs.append(np.maximum(x["rep"][i], y["rep"][j]))
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us), pa.int64()), pa.array(np.concatenate(vs), pa.int64())], names=["u", "v"])

    return both.mapInArrow(run, "u long, v long").distinct()


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
    block: int = BLOCK,
) -> DataFrame:
    """Group documents whose sets of ``k``-word shingles have a Jaccard similarity of ``percent``/100 or more.

    Returns one row for each document: ``doc_id, n_shingles, component_id, kept``;
    ``component_id`` is the smallest id that a chain of links reaches.

    1. Documents with the same shingle set are one representative from here on.
    2. Banding puts representatives into buckets. Each is checked, on full sets, against the
       smallest one of each of its buckets: as many pairs as there are bucket members, however
       large the bucket. Components of these links follow.
    3. Members of one bucket that are still in different components are compared by signature,
       block by block, and what looks similar is checked on full sets. These links join whole
       components. Pairs inside a component need no check, so nothing is lost.

    Work that grows with a bucket's square: step 3 sends each member of such a bucket to one block in
    ``block`` of the members outside the largest component, and compares those. Sets that lie
    around the similarity asked for share bands whether they link or not, so no banding parts them.

    Null, empty and blank texts have an empty set, link with nothing and are kept. Ids must be
    integers; rows that repeat an id share its component through any of their texts; a null id is kept
    and links with nothing. Other columns are not looked at.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = cut(signatures(docs, "doc_id", "text", k, bands, rows))
    usable = signed.filter("n_shingles > 0 and doc_id is not null")
    key = ["s1", "s2", "n_shingles"]
    sets = usable.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("c"))
    reps = usable.join(sets.select(F.col("rep").alias("doc_id"), *key), ["doc_id", *key], "left_semi")
    reps = reps.select("doc_id", "n_shingles", "bands", "sketch")
    buckets = reps.select(F.explode("bands").alias("bucket"), F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"))
    # What is joined with a large bucket's rows is written first, so that adaptive execution can split those.
    hubs = cut(buckets.groupBy("bucket").agg(F.min(F.struct("rep", "n")).alias("hub"), F.count("*").alias("c")).filter("c > 1").select("bucket", "hub"))
    members = cut(buckets.join(hubs, "bucket"))
    pairs = members.filter(
        (F.col("rep") > F.col("hub.rep"))
        & (100 * F.least("n", "hub.n") >= percent * F.greatest("n", "hub.n"))
    ).select(F.col("hub.rep").alias("u"), F.col("rep").alias("v")).distinct()
    texts = docs.filter("text is not null and doc_id is not null")
    labels = connected_components(_verify(pairs, texts, k, percent))
    labelled = members.select("bucket", "rep", "n").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    labelled = labelled.withColumn("component", F.coalesce("component", "rep"))
    mixed = cut(_mixed(labelled, block))
    links = _repeated(usable, sets)
    if not mixed.isEmpty():
        rest = labelled.join(mixed, "bucket")
        rest = rest.join(reps.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "bands", "sketch"), ["rep", "n"])
        links = links.unionByName(_verify(cut(_cross_pairs(rest, percent)), texts, k, percent))
    labels = _joined(labels, links)
    found = sets.join(labels.withColumnRenamed("node", "rep"), "rep", "left").filter("c > 1 or component <> rep")
    found = found.select(*key, F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", *key).join(found, key, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _mixed(labelled: DataFrame, block: int) -> DataFrame:
    """Buckets whose members are in more than one component: the largest one, and counts of blocks."""
    per = labelled.groupBy("bucket", "component").agg(F.count("*").alias("c"))
    per = per.groupBy("bucket").agg(F.max(F.struct("c", "component")).alias("top"), F.sum("c").alias("size"), F.count("*").alias("parts"))
    blocks = lambda n: F.ceil(n / block).cast("int")
    return per.filter("parts > 1").select(
        "bucket", F.col("top.component").alias("major"), blocks(F.col("size")).alias("na"), blocks(F.col("size") - F.col("top.c")).alias("nb")
    )


def _repeated(usable: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between the representatives of different sets that rows of one id have."""
    twice = usable.groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1").select("doc_id")
    of = usable.select("doc_id", "s1", "s2", "n_shingles").join(twice, "doc_id", "left_semi").join(sets, ["s1", "s2", "n_shingles"])
    return of.select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).filter("u <> v")


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after further links, which only join components as wholes."""
    end = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in"))
    between = links.join(end("u"), "u", "left").join(end("v"), "v", "left").select(F.coalesce("u_in", "u").alias("u"), F.coalesce("v_in", "v").alias("v"))
    further = connected_components(between)
    out = labels.join(further.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
    out = out.select("node", F.coalesce("to", "component").alias("component"))
    return out.unionByName(further.join(labels.select("node"), "node", "left_anti"))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Keep the document with the smallest id of each near-duplicate group, with all its columns as they were.

    Rows that repeat an id stay or go together. Null, empty and blank texts, and null ids, stay; an empty table gives
    an empty result. Ids must be integers. Documents whose ids are in none of the hash ranges of those that go pass by
    without a shuffle.
    """
    names = [f"c{i}" for i in range(len(df.columns))]  # own names, so that no column of the table can clash
    i = names[df.columns.index(id_col)]
    gone = near_duplicates(df, id_col, text_col, **options).filter(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct()
    gone = cut(gone)
    rows = df.toDF(*names).withColumn("spot", _spot(F.col(i).cast("long")))
    used = F.broadcast(gone.select(_spot(F.col("gone")).alias("spot")).distinct())
    alone = rows.join(used, "spot", "left_anti").select(names)
    maybe = rows.join(used, "spot", "left_semi")
    return alone.unionByName(maybe.join(gone, F.col(i).cast("long") == F.col("gone"), "left_anti").select(names)).toDF(*df.columns)


def _spot(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(SIEVE)).cast("int")
