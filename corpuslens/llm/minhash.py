"""Near-duplicate documents by SuperMinHash signatures, banding and exact verification.

Documents become sets of word shingles (64-bit hashes). Equal sets are one
class. A class's signature takes each shingle's random permutation of the
slots, step by step, and stops as soon as no later step can lower a slot. Bands
of the signature give buckets. Members of a bucket are first compared with its
smallest member, its pivot, which joins most groups. Members of a pivot that are
still in different components are then compared with each other in blocks: a
set is told by which of the pivot's shingles it holds and which others, so that
every comparison is exact and no pair of members ever becomes a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from corpuslens.llm.common import text_of
from corpuslens.llm.components import components
from corpuslens.sources.store import write_table

BANDS = 32
ROWS = 5
BLOCK_ROWS = 512
PACK_BYTES = 4 << 20       # of sets that meet their pivots in one group
SLICE_BYTES = 4 << 20
FILTER_BITS = 1 << 24     # 2 MB
# Odd multipliers of the splitmix64 generator.
GOLDEN = 0x9E3779B97F4A7C15
MIX1 = 0xBF58476D1CE4E5B9
MIX2 = 0x94D049BB133111EB


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX2)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct hashes, sorted, of ``size`` words in a row; a shorter text is one shingle as a whole."""
    if not len(words):
        return words
    size = min(size, len(words))
    out = np.full(len(words) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        out = mixed(out * np.uint64(GOLDEN) + words[i:len(words) - size + 1 + i])
    return np.unique(out)


def super_minhash(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """SuperMinHash signatures (sets x slots) of non-empty sets.

    In step j every element of a set takes one more slot of its own permutation (a Fisher-Yates step) and offers
    j plus a fraction. A set is done when all its slots hold a value of an earlier step: no later offer is lower.
    """
    best = np.full(len(sets) * slots, np.iinfo(np.uint64).max, dtype=np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    element = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
    order: np.ndarray | None = None     # permutations, made when a second step is needed
    fraction = np.uint64(8)             # a value is the step in the top 8 bits and a random fraction below
    top = np.uint64(56)
    for j in range(slots):
        if not len(element):
            break
        draw = mixed(element + np.uint64((2 * j + 1) * GOLDEN % (1 << 64)))
        pick = j + (mixed(draw ^ np.uint64(GOLDEN)) % np.uint64(slots - j)).astype(np.int64)
        if order is None:
            slot = pick
        else:
            rows = np.arange(len(element))
            slot = order[rows, pick].astype(np.int64)
            order[rows, pick] = order[rows, j]
            order[rows, j] = slot
        np.minimum.at(best, owner * slots + slot, (np.uint64(j) << top) | (draw >> fraction))
        worst = best.reshape(len(sets), slots).max(axis=1)
        open_sets = worst >= (np.uint64(j + 1) << top)
        stay = open_sets[owner]
        if not stay.all() or order is None:
            if order is None:
                n = int(stay.sum())
                order = np.broadcast_to(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16),
                                        (n, slots)).copy()
                first = slot[stay]      # the swap of step 0
                order[np.arange(n), first] = order[np.arange(n), 0]
                order[np.arange(n), 0] = first
            else:
                order = order[stay]
            owner, element = owner[stay], element[stay]
    return best.reshape(len(sets), slots)


def sign_documents(docs: DataFrame, id_col: str, text_col: str, size: int, bands: int, rows: int) -> DataFrame:
    """(id, t, n_shingles, h1, h2, bands) per document: hashes of its text (t), its set (128 bits) and its bands.

    A document without words has no bands.
    """
    slots = bands * rows

    @F.pandas_udf("n_shingles long, h1 long, h2 long, bands array<long>")
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            texts, out, end = texts.tolist(), [], 0
            while end < len(texts):             # groups of bounded size
                size_of, sets = 0, []
                while end < len(texts) and size_of < 50_000:
                    sets.append(shingles(word_hashes(texts[end]), size))
                    size_of += len(sets[-1])
                    end += 1
                whole = b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets)
                halves = np.frombuffer(whole, dtype=np.int64).reshape(-1, 2)
                full = [i for i, s in enumerate(sets) if len(s)]
                sig = super_minhash([sets[i] for i in full], slots)
                band = np.zeros((len(full), bands), dtype=np.uint64)
                for r in range(rows):
                    band = mixed(band * np.uint64(GOLDEN) + sig.reshape(len(full), bands, rows)[:, :, r])
                bucket = [np.zeros(0, dtype=np.int64)] * len(sets)
                for k, i in enumerate(full):
                    bucket[i] = band[k].view(np.int64)
                out.append(pd.DataFrame({"n_shingles": [len(s) for s in sets], "h1": halves[:, 0], "h2": halves[:, 1],
                                         "bands": bucket}))
            yield pd.concat(out, ignore_index=True)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_of(text_col)).alias("t"),
                       sign(text_of(text_col)).alias("s")).select("id", "t", "s.*")


def named_texts(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, text) of the documents named by ``nodes`` (node, id, t): by id and text, as ids may repeat.

    A bitmap of FILTER_BITS hash values of the nodes, of a fixed size, drops most other texts before they move; it
    may let some pass, and a full one would let all pass. The join decides.
    """
    def slot(column: str):
        return F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))

    parts = (nodes.select(slot("id").alias("s"))
             .groupBy(F.floor(F.col("s") / 32768).alias("part"))
             .agg(F.bitmap_construct_agg(F.pmod("s", F.lit(32768))).alias("bits")).collect())  # 4 KB a row
    bitmap = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for p in parts:
        bitmap[p.part * 4096:(p.part + 1) * 4096] = np.frombuffer(p.bits, dtype=np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap.tobytes())

    @F.pandas_udf("boolean")
    def may_be_named(s: pd.Series) -> pd.Series:
        bits, s = np.frombuffer(shared.value, dtype=np.uint8), s.to_numpy()
        return pd.Series((bits[s >> 3] >> (s & 7)) & 1 == 1)

    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    met = texts.filter(may_be_named(slot("id"))).withColumn("t", F.xxhash64("text"))
    return met.join(nodes, ["id", "t"]).select("node", "text")


def sets_of(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(node, set) of the documents named by ``nodes``, from their texts; the set as bytes of sorted hashes."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:           # texts become Python strings one by one, sets leave in slices of bounded bytes
            nodes, sets, held = [], [], 0
            for node, text in zip(b.column("node"), b.column("text")):
                nodes.append(node.as_py())
                sets.append(shingles(word_hashes(text.as_py()), size).tobytes())
                held += len(sets[-1])
                if held >= SLICE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())],
                                                     ["node", "set"])
                    nodes, sets, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())],
                                             ["node", "set"])

    return named_texts(docs, nodes, id_col, text_col).mapInArrow(build, "node long, set binary")


def seen_from(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Every (node, pivot) with the node's set as seen from the pivot's, and whether they link.

    ``pairs``: node, pivot, bytes (of the node's set). ``held`` is a bitmap of the pivot's shingles (sorted) that the
    node has; ``others`` are the node's further ones. A pivot's set goes once to each block of its members, and blocks
    meet in packs of about PACK_BYTES.
    """
    sizes = write_table(pairs.groupBy("pivot").agg(F.sum("bytes").alias("bytes"), F.max("bytes").alias("_most")),
                        "pivot-sizes")
    # the pivot's own set is about as large as its members'
    total = sizes.agg(F.sum(F.col("bytes") + F.col("_most"))).first()[0] or 0
    packs = int(max(1, total // PACK_BYTES))
    sizes = sizes.select("pivot", F.ceil(F.col("bytes") / PACK_BYTES).cast("int").alias("blocks"))

    def packed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("pack", F.pmod(F.xxhash64(F.lit("pack"), "pivot", "block"), F.lit(packs)))

    members = pairs.join(sizes, "pivot").withColumn("block", F.expr("cast(pmod(xxhash64('block', node), blocks) as int)"))
    mine = packed(members.select("node", "pivot", "block")).join(
        sets.select("node", F.col("set").alias("_mine")), "node").select("pack", "node", "pivot", "_mine")
    its = packed(sizes.withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).select("pivot", "block")).join(
        sets.select(F.col("node").alias("pivot"), F.col("set").alias("_its")), "pivot").select("pack", "pivot", "_its")

    def look(members: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        its_set = {p: np.frombuffer(s, dtype=np.uint64) for p, s in zip(pivots["pivot"], pivots["_its"])}
        held, others, linked, size = [], [], [], []
        for pivot, x in zip(members["pivot"], members["_mine"]):
            x, p = np.frombuffer(x, dtype=np.uint64), its_set[pivot]
            at = np.minimum(np.searchsorted(p, x), max(len(p) - 1, 0))
            common = p[at] == x if len(p) else np.zeros(len(x), dtype=bool)
            bits = np.zeros(-(-len(p) // 64) * 64, dtype=np.uint8)
            bits[at[common]] = 1
            both = int(common.sum())
            held.append(np.packbits(bits).tobytes())
            others.append(x[~common].tobytes())
            linked.append(both > 0 and 100 * both >= percent * (len(x) + len(p) - both))
            size.append(len(x))
        return pd.DataFrame({"node": members["node"], "pivot": members["pivot"], "n": size, "held": held,
                             "others": others, "linked": linked})

    return mine.groupBy("pack").cogroup(its.groupBy("pack")).applyInPandas(
        look, "node long, pivot long, n long, held binary, others binary, linked boolean")


def links(docs: DataFrame, signed: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """(a, b): confirmed links that join every two classes which the candidate links join.

    ``signed``: node, n_shingles, bands, id and t of every class. Full sets are made again from the texts, for classes that share a bucket
    only.
    """
    places = signed.select("node", (8 * F.col("n_shingles")).alias("bytes"), F.posexplode("bands").alias("band", "bucket"))
    buckets = (places.groupBy("band", "bucket")
               .agg(F.count("*").alias("members"), F.min("node").alias("pivot")).filter("members > 1"))
    pairs = write_table(places.join(buckets, ["band", "bucket"]).select("node", "pivot", "bytes").distinct(), "pivots")
    nodes = signed.select("node", "id", "t").join(pairs.select("node").distinct(), "node")
    sets = write_table(sets_of(docs, nodes, id_col, text_col, size), "candidate-sets")
    views = write_table(seen_from(pairs.filter("node <> pivot"), sets, percent), "pivot-views")
    stars = views.filter("linked").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    joined = components(stars)
    return stars.union(across(views, joined, percent))


def across(views: DataFrame, joined: DataFrame, percent: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b): links between members of a pivot that are in different components, one per pair of components found.

    Members outside the pivot's commonest component meet all members, in blocks of bounded size.
    """
    member = views.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    shares = member.groupBy("pivot", "component").agg(F.count("*").alias("c"))
    groups = (shares.groupBy("pivot").agg(F.max_by("component", F.struct("c", "component")).alias("main"),
                                          F.sum("c").alias("members"), F.max("c").alias("most"))
              .filter("most < members")
              .withColumn("blocks", F.expr(f"cast(ceil(members / {block_rows}) as int)"))
              .withColumn("strays", F.expr(f"cast(ceil((members - most) / {block_rows}) as int)")))
    open_ = write_table(member.join(write_table(groups, "pivot-groups"), "pivot"), "open-groups")
    columns = ["node", "n", "component", "held", "others"]
    # int on both sides: partitions are chosen by a hash, and that of a long is another one
    left = (open_.filter("component <> main").withColumn("i", F.expr("cast(pmod(xxhash64('i', node), strays) as int)"))
            .withColumn("j", F.explode(F.expr("sequence(0, blocks - 1)"))).select("pivot", "i", "j", *columns))
    right = (open_.withColumn("j", F.expr("cast(pmod(xxhash64('j', node), blocks) as int)"))
             .withColumn("i", F.explode(F.expr("sequence(0, strays - 1)")))
             .select(*[F.col(c).alias(f"r_{c}") for c in ["pivot", "i", "j", *columns]]))

    def bits(column) -> np.ndarray:
        return np.stack([np.frombuffer(h, dtype=np.uint64) for h in column])

    def compare(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        found: dict[tuple[int, int], tuple[int, int]] = {}
        if len(x) and len(y):
            hx, hy = bits(x["held"]), bits(y["r_held"])
            ny, cy, ids = y["r_n"].to_numpy(), y["r_component"].to_numpy(), y["r_node"].to_numpy()
            more = [np.frombuffer(o, dtype=np.uint64) for o in y["r_others"]]
            value = np.concatenate(more)
            owner = np.repeat(np.arange(len(more)), [len(o) for o in more])
            order = np.argsort(value, kind="stable")
            value, owner = value[order], owner[order]
            for node, n, component, held, others in zip(x["node"], x["n"], x["component"], hx, x["others"]):
                near = np.flatnonzero((cy != component) & (100 * np.minimum(n, ny) >= percent * np.maximum(n, ny)))
                if not len(near):
                    continue
                both = np.bitwise_count(hy[near] & held).sum(axis=1).astype(np.int64)
                own = np.frombuffer(others, dtype=np.uint64)
                first, last = np.searchsorted(value, own, "left"), np.searchsorted(value, own, "right")
                hits = [owner[i:j] for i, j in zip(first, last) if j > i]
                if hits:
                    both += np.bincount(np.concatenate(hits), minlength=len(y))[near]
                for k in near[100 * both >= percent * (n + ny[near] - both)].tolist():
                    found.setdefault((component, int(cy[k])), (node, int(ids[k])))
        return pd.DataFrame(list(found.values()), columns=["a", "b"], dtype="int64")

    return left.groupBy("pivot", "i", "j").cogroup(right.groupBy("r_pivot", "r_i", "r_j")).applyInPandas(
        compare, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id",
                    text_col: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per document: its id, n_shingles, component_id (the smallest id it is linked with) and kept.

    Words are runs of non-space characters with A-Z lower-cased. A document's set holds its distinct shingles of
    ``size`` words, or all its words as one shingle if there are fewer; without words it is empty and links with
    nothing. Documents link when 100 * intersection >= ``percent`` * union; equal sets always do. Rows with a null
    id link with nothing and are kept; rows that repeat an id, with the same text or others, are one document and share
    its component. An empty table gives no rows.
    With 32 bands of 5 rows a link of similarity 0.8 misses all buckets with a probability of about 3e-6.
    """
    kind = docs.schema[id_col].dataType
    rows_of = write_table(sign_documents(docs, id_col, text_col, size, bands, rows), "document-signatures")
    usable = rows_of.filter("id IS NOT NULL AND n_shingles > 0")
    # A class has a number of its own: its smallest id may be that of another class too.
    classes = write_table(usable.groupBy("h1", "h2").agg(
        F.min(F.struct("id", "t")).alias("first"), F.first("bands").alias("bands"),
        F.first("n_shingles").alias("n_shingles"))
        .select(F.monotonically_increasing_id().alias("node"), "h1", "h2", "first.id", "first.t", "n_shingles", "bands"),
        "set-classes")
    # ids with more than one set: all their rows are one document
    several = write_table(rows_of.filter("id IS NOT NULL").groupBy("id").agg(
        F.min(F.struct("h1", "h2")).alias("_low"), F.max(F.struct("h1", "h2")).alias("_high"))
        .filter("_low <> _high").select("id"), "repeated-ids")
    places = write_table(usable.join(several, "id").select("id", "h1", "h2").distinct()
                         .join(classes.select("node", "h1", "h2"), ["h1", "h2"]).select("id", "node"), "repeated-places")
    meeting = places.groupBy("id").agg(F.min("node").alias("b"))
    same = places.join(meeting, "id").select(F.col("node").alias("a"), "b")
    joined = components(links(docs, classes, id_col, text_col, size, percent).union(same))
    # written, so that the join below can deal out a very large component
    linked = write_table(classes.select("node", "id").join(joined, "node"), "linked-classes")
    least = linked.groupBy("component").agg(F.min("id").alias("component_id"))
    named = linked.join(least, "component").select("node", "component_id")
    per_class = (classes.select("h1", "h2", "node", "id").join(named, "node", "left")
                 .select("h1", "h2", "node", F.coalesce("component_id", "id").alias("component_id")))
    per_class = write_table(per_class, "class-components")
    # rows without words whose id has others with words
    wordless = (meeting.join(per_class.select(F.col("node").alias("b"), "component_id"), "b")
                .select("id", F.col("component_id").alias("_other")))
    per_class = per_class.drop("node")
    out = rows_of.select("id", "n_shingles", "h1", "h2").join(
        per_class, ["h1", "h2"], "left").join(wordless, "id", "left").withColumn(
        "component_id", F.when(F.col("id").isNotNull() & (F.col("n_shingles") > 0), F.col("component_id"))
        .otherwise(F.coalesce("_other", "id")))
    return out.select(F.col("id").cast(kind).alias(id_col), "n_shingles", "component_id",
                      F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
